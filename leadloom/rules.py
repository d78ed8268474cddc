"""Rule sets of the engine.

The literals below are fixed values: results only agree with the published
behaviour when these lists, thresholds and patterns are exactly these.  They
are defaults; every operator that reads one takes it as an argument.
"""

# ---------------------------------------------------------------- fixed values
CONTACT_HINTS = (
    "contact", "contact-us", "contactus", "kontakt", "iletisim", "iletişim",
    "bize-ulasin", "contacto", "contatti", "nous-contacter",
    "impressum", "imprint", "legal-notice", "mentions-legales",
    "privacy-policy", "privacy", "datenschutz", "gizlilik",
    "legal", "terms", "terms-of-service", "dpa", "gdpr",
    "about", "about-us", "aboutus", "hakkimizda", "team", "our-team", "staff",
    "people", "leadership", "management",
    "support", "help", "customer-service", "sales",
    "press", "media", "careers", "jobs", "locations", "offices", "franchise",
    "security", "abuse", "trust",
)
CONTACT_URL_HINT_COUNT = 20

SKIP_DOMAINS = (
    "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com",
    "youtube.com", "youtu.be", "tiktok.com", "pinterest.com", "reddit.com",
    "wikipedia.org", "wikimedia.org", "google.com", "gstatic.com",
    "googleusercontent.com", "doubleclick.net", "amazon.com", "ebay.com",
    "aliexpress.com", "alibaba.com", "trendyol.com", "hepsiburada.com",
    "n11.com", "sahibinden.com", "daraz.pk", "olx.com.pk", "yelp.com",
    "tripadvisor.com", "booking.com", "indeed.com", "glassdoor.com",
    "medium.com", "blogspot.com", "wordpress.com", "wix.com", "github.io",
    "apple.com", "microsoft.com", "cloudflare.com", "jsdelivr.net",
    "unpkg.com", "bootstrapcdn.com", "fontawesome.com", "w3.org",
    "schema.org", "archive.org", "t.me", "whatsapp.com", "play.google.com",
    "zocdoc.com", "healthgrades.com", "vitals.com", "practo.com",
    "justdial.com", "lybrate.com", "clutch.co", "goodfirms.co",
    "trustpilot.com", "thumbtack.com", "bark.com", "angieslist.com",
    "yellowpages.com", "yell.com", "thomsonlocal.com", "hotfrog.com",
    "cylex.com", "infobel.com",
)
SKIP_EXTENSIONS = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip",
    ".rar", ".7z", ".tar", ".gz", ".bz2", ".exe", ".dmg", ".pkg", ".apk",
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".bmp",
    ".tif", ".tiff", ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".flv",
    ".webm", ".wav", ".ogg", ".css", ".js", ".json", ".xml", ".rss",
    ".woff", ".woff2", ".ttf", ".eot", ".map", ".csv",
)
INFRA_DOMAINS = (
    "wix.com", "wordpress.com", "squarespace.com", "godaddy.com",
    "cloudflare.com", "jsdelivr.net", "unpkg.com", "bootstrapcdn.com",
    "fontawesome.com", "googleapis.com", "gstatic.com", "google-analytics.com",
    "googletagmanager.com", "doubleclick.net", "hotjar.com", "sentry.io",
    "recaptcha.net", "adobe.com", "microsoft.com", "apple.com", "mozilla.org",
    "w3.org", "schema.org", "creativecommons.org", "gravatar.com",
    "shopify.com", "hubspot.com", "mailchimp.com", "typeform.com",
)
EMAIL_BLOCKLIST = (
    "example.com", "example.org", "email.com", "domain.com", "yourdomain.com",
    "yoursite.com", "sitename.com", "test.com", "sample.com", "wix.com",
    "wordpress.com", "squarespace.com", "godaddy.com", "sentry.io",
    "sentry-next.wixpress.com", "wixpress.com", "google-analytics.com",
    "googlemail.example", "yandex-team.ru", "jquery.com", "bootstrapcdn.com",
    "fontawesome.com", "w3.org", "schema.org", "adobe.com", "mysite.com",
    "your-email.com", "yourcompany.com", "companyname.com", "placeholder.com",
)
EMAIL_LOCAL_BLOCKLIST = (
    "email", "youremail", "your-email", "name", "yourname", "user",
    "username", "example", "test", "sample", "somebody", "someone",
    "firstname", "lastname", "no-reply", "noreply", "donotreply",
    "do-not-reply", "sentry", "wixpress", "core-services",
)
ROLE_LOCALS = (
    "info", "contact", "hello", "hi", "mail", "email", "office", "admin",
    "sales", "support", "help", "service", "enquiries", "enquiry",
    "inquiry", "team", "general", "marketing", "press", "media", "hr",
    "jobs", "careers", "billing", "accounts", "finance", "webmaster",
    "postmaster", "bilgi", "iletisim", "kontakt",
)
FREEMAIL = (
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.uk", "hotmail.com",
    "outlook.com", "live.com", "msn.com", "aol.com", "icloud.com", "me.com",
    "proton.me", "protonmail.com", "gmx.com", "mail.com", "yandex.com",
    "zoho.com", "tutanota.com", "hotmail.co.uk", "qq.com", "163.com",
)
WEBMAIL_LABELS = ("gmail", "yahoo", "hotmail", "outlook", "proton")
BAD_EMAIL_TLDS = (
    "png", "jpg", "jpeg", "gif", "webp", "svg", "js", "css", "json", "html",
    "php", "aspx", "min", "map", "woff", "ttf", "mp4", "webp2", "ico", "xml",
    "txt", "zip", "gz",
)
SECOND_LEVEL_LABELS = (
    "co", "com", "net", "org", "gov", "edu", "ac", "mil", "or", "ne", "go",
    "in", "web", "biz", "info", "sch", "gob", "gouv", "nom", "id",
)
TRACKING_PREFIXES = (
    "utm_", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "ref", "source",
    "igshid", "_ga", "yclid", "pk_campaign", "pk_kwd", "s_kwcid", "dclid",
    "twclid", "scid",
)
REJECTED_HREF_PREFIXES = ("javascript:", "mailto:", "tel:", "data:", "#", "sms:")
METADATA_HOSTS = (
    "169.254.169.254", "metadata.google.internal", "metadata.goog",
    "100.100.100.100", "192.0.0.192", "fd00:ec2::254",
)
LOCAL_NAMES = (
    "localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback",
    "127.0.0.1", "0.0.0.0", "::1", "[::1]",
)
LOCAL_SUFFIXES = (".localhost", ".local", ".internal", ".localdomain")
BLOCKED_PORTS = (
    22, 23, 25, 445, 587, 993, 995,
    1433, 1521, 3306, 5432, 6379, 9200,
    2375, 2376, 5984, 7001, 8020, 9000,
    11211, 27017, 50070,
)
# IANA special-purpose IPv4 blocks plus multicast and carrier-grade NAT.
PRIVATE_IPV4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8",
    "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "224.0.0.0/4", "240.0.0.0/4",
)
PUBLIC_IPV4_EXCEPTIONS = ("192.0.0.9", "192.0.0.10")
SITEMAP_CONTACT_KEYWORDS = (
    "contact", "about", "team", "support", "impressum", "imprint",
    "get-in-touch", "reach-us", "legal", "privacy", "locations",
    "office", "staff", "people", "careers",
)
SITEMAP_GUESS_PATHS = ("contact", "contact-us", "about", "about-us")
MAX_SITEMAPS = 25
MAX_SITEMAP_URLS = 2000
MAX_SITEMAP_DEPTH = 3
MAX_SITEMAP_CHARS = 20_000_000
MAX_ROBOTS_CHARS = 512_000
CDX_LIMIT = 40
BLOCK_MARKERS = (
    "anomaly", "captcha", "unusual traffic", "are you a robot",
    "verify you", "challenge", "temporarily blocked", "robot check",
)
MX_PLATFORMS = (
    ("google|googlemail|aspmx", "Google Workspace"),
    (r"outlook|microsoft|office365|protection\.outlook", "Microsoft 365"),
    ("zoho", "Zoho Mail"),
    (r"protonmail|proton\.me", "Proton"),
    ("yandex", "Yandex"),
    ("mimecast", "Mimecast"),
    ("barracuda", "Barracuda"),
    ("pphosted|proofpoint", "Proofpoint"),
    ("secureserver|godaddy", "GoDaddy"),
    ("hostinger|namecheap|bluehost|siteground", "Shared hosting"),
)
CATEGORY_TAGS = (
    (r"\b(school|schools|academy|academies|kindergarten)\b",
     ("amenity=school", "amenity=kindergarten")),
    (r"\b(universit|college|institute)\w*\b",
     ("amenity=university", "amenity=college")),
    (r"\b(restaurant|dining|eatery|food)\b",
     ("amenity=restaurant", "amenity=fast_food")),
    (r"\b(cafe|cafes|coffee|coffeeshop)\b", ("amenity=cafe",)),
    (r"\b(hotel|hotels|motel|hostel|accommodation)\b",
     ("tourism=hotel", "tourism=guest_house")),
    (r"\b(hospital|clinic|medical|healthcare)\b",
     ("amenity=hospital", "amenity=clinic")),
    (r"\b(dentist|dentists|dental)\b", ("amenity=dentist",)),
    (r"\b(pharmacy|pharmacies|chemist)\b", ("amenity=pharmacy",)),
    (r"\b(doctor|doctors|physician|gp)\b", ("amenity=doctors",)),
    (r"\b(lawyer|lawyers|solicitor|attorney|law firm)\b", ("office=lawyer",)),
    (r"\b(gym|gyms|fitness)\b", ("leisure=fitness_centre",)),
    (r"\b(bank|banks)\b", ("amenity=bank",)),
    (r"\b(garage|mechanic|car repair)\b", ("shop=car_repair",)),
    (r"\b(salon|barber|hairdresser)\b", ("shop=hairdresser", "shop=beauty")),
    (r"\b(bakery|bakeries)\b", ("shop=bakery",)),
    (r"\b(real estate|realtor|estate agent)\b", ("office=estate_agent",)),
    (r"\b(agency|agencies|marketing|consult\w*|company|companies|startup|software|studio)\b",
     ("office=company", "office=it", "office=consulting", "office=advertising_agency")),
    (r"\b(shop|shops|store|stores|retail)\b", ("shop=yes",)),
)
DEFAULT_TAGS = ("office=company", "shop=yes")
COMPANY_WORDS = (
    "compan|corporat|business|enterprise|firm|organi[sz]ation|"
    "school|universit|college|institut|bank|agency|agencies|studio|startup|"
    "manufactur|retail|software|technolog|service|group|holding|"
    "hospital|clinic|hotel|restaurant|publisher|charit|nonprofit|"
    "provider|consultanc|developer|brand"
)
NAVIGATION_LABELS = (
    "home", "homepage", "welcome", "index", "main", "start",
    "untitled", "page", "default", "site",
)
JSONLD_TYPES = (
    "organization", "localbusiness", "corporation", "person", "restaurant",
    "store", "professionalservice", "medicalbusiness", "website", "webpage",
    "dentist", "hotel", "school",
)
JSONLD_CHILD_KEYS = ("@graph", "mainEntity", "itemListElement", "publisher", "author")
JSONLD_MAX_BLOCKS, JSONLD_MAX_DEPTH, JSONLD_MAX_ITEMS = 12, 6, 50
SOCIAL_RESERVED = (
    "home", "login", "signup", "help", "privacy", "terms",
    "pages", "profile.php", "sharer.php", "search", "explore",
)
SOCIAL_BASES = {
    "linkedin": "https://www.linkedin.com/",
    "twitter": "https://twitter.com/",
    "facebook": "https://www.facebook.com/",
    "instagram": "https://www.instagram.com/",
    "tiktok": "https://www.tiktok.com/",
    "youtube": "https://www.youtube.com/",
    "github": "https://github.com/",
    "medium": "https://medium.com/",
    "telegram": "https://t.me/",
    "whatsapp": "https://wa.me/",
}
SOCIAL_KINDS = tuple(SOCIAL_BASES)
CONTACT_KINDS = ("email", "phone", *SOCIAL_KINDS, "address", "website")
EXPORT_COLUMNS = (
    "domain", "name", "score", "emails", "phones", "website", "address",
    "linkedin", "twitter", "facebook", "instagram", "youtube", "tiktok",
    "github", "telegram", "whatsapp", "medium",
    "rating", "reviews", "category", "latitude", "longitude",
    "title", "description", "source", "pages_crawled", "fetched_at",
)
RETRYABLE_STATUS = (408, 425, 429, 500, 502, 503, 504, 520, 521, 522, 524)
PROXY_BURN_STATUS = (403, 407, 429)
PROXY_BURN_STRIKES = 3
DELAY_CEILING, DELAY_FLOOR_ON_FAILURE, DELAY_GROWTH, DELAY_DECAY = 30.0, 1.0, 2.0, 0.8
CACHE_TTL_SECONDS = 86_400
MAX_BODY_BYTES = 3_000_000
TEXTUAL_TYPES = ("html", "text", "json", "xml", "javascript")
MAX_EMAILS_PER_LEAD = 25
MAX_PAGES_PER_SITE = 6
MAX_OUTBOUND_ORGS = 60
MAX_DIRECTORY_LINKS = 40
NAMED_INTERVALS = {"@hourly": 3600, "@daily": 86_400, "@weekly": 604_800, "@monthly": 2_592_000}
INTERVAL_UNITS = {"s": 1, "sec": 1, "m": 60, "min": 60, "h": 3600, "hour": 3600,
                  "d": 86_400, "day": 86_400}

# Patterns.  (?U) makes \w, \s, \d and \b follow Unicode; repeated groups are
# bounded because the JVM matcher recurses on them.
EMAIL_BODY = (r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@"
              r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,126}[A-Za-z]{2,24}")
EMAIL = r"(?U)(?<![\w.+-])" + EMAIL_BODY + r"(?![\w-])"
_DOT_WORDS = r"\s*[(\[{]\s*(?:dot|punkt|nokta|punto)\s*[)\]}]\s*"
OBFUSCATED_MARK = (r"(?iU)([A-Za-z0-9._%+-]{1,64}?)(?:\s*[(\[{]\s*at\s*[)\]}]\s*|\s*@\s*)"
                   r"((?:[A-Za-z0-9-]{1,63}(?:" + _DOT_WORDS + r"|\.)){1,126}[A-Za-z]{2,24}\b)")
OBFUSCATED_WORD = (r"(?iU)([A-Za-z0-9._%+-]{1,64}?)\s+(?:at|arroba|chiocciola)\s+"
                   r"((?:[A-Za-z0-9-]{1,63}(?:" + _DOT_WORDS +
                   r"|\s+(?:dot|punkt|nokta|punto)\s+)){1,126}[A-Za-z]{2,24}\b)")
DOT_WORD = r"(?iU)\s*[(\[{]?\s*(?:dot|punkt|nokta|punto)\s*[)\]}]?\s*"
JS_CONCAT = (r"(?U)['\"]([A-Za-z0-9._%+-]{1,64})['\"]\s*\+\s*['\"]@?['\"]\s*\+\s*['\"]@?"
             r"([A-Za-z0-9.-]+\.[A-Za-z]{2,})['\"]")
CFEMAIL = r'data-cfemail="([0-9a-fA-F]+)"'
MAILTO = r"(?iU)(?:href|content)\s*=\s*[\"']\s*mailto:([^\"'?>]+)"
TEL = r"(?iU)href\s*=\s*[\"']\s*tel:([+0-9().\-\s]{6,})[\"']"
PHONE_BODY = (r"(?:\+|00)?\d{1,3}[\s.\-]?(?:\(\d{1,4}\)[\s.\-]?)?"
              r"\d{2,4}(?:[\s.\-]?\d{2,4}){1,4}(?:\s*(?:ext|x|extn|poste)\.?\s*\d{1,5})?")
PHONE = r"(?<![\w.])" + PHONE_BODY + r"(?![\w.])"
PHONE_CUES = ("tel", "phone", "call", "mobile", "cell", "fax", "whatsapp", r"whats\sapp", "contact", "hotline",
              "telefon", "téléphone", "teléfono", "telefono", "هاتف", "جوال", "اتصل")
PHONE_CUE_SEPARATOR = r"[\s.:\-–—]"
PHONE_CUE_WINDOW = 40
SOCIAL_PATTERNS = {
    "linkedin": r"(?iU)https?://(?:[a-z0-9-]+\.)?linkedin\.com/((?:in|company|school|pub)/[A-Za-z0-9_%\-.]{2,100})",
    "twitter": r"(?iU)https?://(?:www\.|mobile\.)?(?:twitter|x)\.com/(?!(?:share|intent|home|search|hashtag|i/)\b)([A-Za-z0-9_]{1,15})",
    "facebook": r"(?iU)https?://(?:www\.|web\.|m\.|business\.)?facebook\.com/(?!(?:sharer|share|tr|plugins|dialog|events/create)\b)([A-Za-z0-9_.\-]{2,80})",
    "instagram": r"(?iU)https?://(?:www\.)?instagram\.com/(?!(?:p|reel|reels|explore|stories|accounts)/)([A-Za-z0-9_.]{1,30})",
    "tiktok": r"(?iU)https?://(?:www\.|m\.)?tiktok\.com/(@[A-Za-z0-9_.]{1,30})",
    "youtube": r"(?iU)https?://(?:www\.|m\.)?youtube\.com/(channel/[A-Za-z0-9_\-]{6,}|c/[A-Za-z0-9_\-]{2,}|@[A-Za-z0-9_.\-]{2,}|user/[A-Za-z0-9_\-]{2,})",
    "github": r"(?iU)https?://(?:www\.)?github\.com/(?!(?:features|about|pricing|topics|collections|events|sponsors)\b)([A-Za-z0-9_\-]{1,39})(?:/([A-Za-z0-9_.\-]{1,100}))?",
    "medium": r"(?iU)https?://(?:www\.)?medium\.com/(@?[A-Za-z0-9_\-]{2,60})",
    "telegram": r"(?iU)https?://(?:www\.)?(?:t\.me|telegram\.me)/([A-Za-z0-9_]{4,32})",
    "whatsapp": r"(?iU)https?://(?:api\.whatsapp\.com/send\?phone=|wa\.me/)(\+?\d{6,15})",
}
HREF = r"(?isU)<a\b[^>]*?href\s*=\s*[\"']([^\"'>]+)[\"']"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
META_DESCRIPTION = (r"(?iU)<meta[^>]+(?:name|property)\s*=\s*[\"'](?:description|og:description)"
                    r"[\"'][^>]*content\s*=\s*[\"']([^\"']*)[\"']")
META_SITE = (r"(?iU)<meta[^>]+property\s*=\s*[\"']og:site_name[\"'][^>]*"
             r"content\s*=\s*[\"']([^\"']*)[\"']")
JSONLD = r"(?isU)<script[^>]+type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
SCRIPT_STYLE = r"(?isU)<(script|style|noscript|svg)\b[^>]*>.*?</\1>"
STATE_BLOB = (r"(?isU)<script[^>]*>\s*(?:self\.__next_f\.push\(|window\.__NUXT__\s*=|"
              r"window\.__INITIAL_STATE__\s*=|window\.__APOLLO_STATE__\s*=|"
              r"window\.__PRELOADED_STATE__\s*=|window\.__remixContext\s*=)(.*?)</script>")
JSON_SCRIPT = r"(?isU)<script[^>]+type\s*=\s*[\"']application/json[\"'][^>]*>(.*?)</script>"
ESCAPED_AT = r"(?i)\\u0040|\\x40|&#0*64;|&commat;"
ESCAPED_DOT = r"(?i)\\u002e|\\x2e|&#0*46;|&period;"
MAX_STATE_CHARS = 4_000_000
TAG = r"<[^>]+>"
IMAGE_TAIL = r"\.(png|jpe?g|gif|webp|svg|ico|bmp|tiff?|avif)$"
HEADLINE = (r"(?iU)\b(top|best|guide|ranking|rankings|rating|ratings|review|reviews|"
            r"list of|how to|what is|why |vs\.?|cheap|compare|near me|"
            r"ultimate|complete|ideas|tips|examples|cost|price|prices|fees)\b")
DIRECTORY_URL = (r"(?i)/(?:schools?|companies|businesses|listings?|directory|directories|"
                 r"category|categories|cities|city|places|top-?\d+|best-|list-of-|guides?)(?:/|$|-)")
DDG_RESULT = r'(?i)<a[^>]+class="[^"]*result__a[^"]*"[^>]+href="([^"]+)"'
DDG_ANY = r'(?i)href="(/l/\?uddg=[^"]+|https?://duckduckgo\.com/l/\?[^"]+)"'
BING_RESULT = r'(?isU)<h2[^>]*>\s*<a[^>]+href="([^"]+)"'
BING_REDIRECT = r"[?&]u=a1([A-Za-z0-9+/=]+)"
# ----------------------------------------------------------------------- end
