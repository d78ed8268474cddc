"""Registered queries of the training-data operators, with SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(configure(spark), sf)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Smallest id reachable over ``links(a, b)``; ``nodes(id)`` has every id.
_REACH = """
, both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, other) AS (SELECT id, id FROM nodes
    UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
"""


@register("op3_language_id")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every whole text of documents, learnt from rows that are not held out."""
    from .op3_kneser_ney import held_out, identify

    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return identify(docs, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score",
                                 "cross_entropy", "rejected")


_OP5_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          '{_UPPER}', '{_LOWER}') AS key FROM l),
hot AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
        GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE hot.key IS NOT NULL AND hot.keeper <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
                       FILTER (WHERE hot.key IS NULL OR hot.keeper = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN hot ON k.key = hot.key GROUP BY k.doc_id
"""


@register("op5_line_dedup", _OP5_SQL)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of whole documents without those that five documents or more share."""
    from .op5_line_runs import dedup_lines

    out = dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op6_quality_classifier")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every whole text of documents, learnt from labels that are not held out."""
    from .op6_histogram_trees import score_quality

    return score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


_OP8_SQL = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                      '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3
        THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id
      GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
          WHERE 100 * m >= 85 * (p.n + q.n - m)),
nodes AS (SELECT doc_id AS id FROM documents)
{_REACH}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept
FROM comp LEFT JOIN n ON n.doc_id = id
"""


@register("op8_minhash_dedup", _OP8_SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate groups of whole documents: three-word shingles, Jaccard similarity of 0.85 or more."""
    from .op8_superminhash import near_duplicates

    return near_duplicates(table(spark, sf, "documents").select("doc_id", "text"), shingle=3, percent=85)


_OP2_SQL = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id
          AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
nodes AS (SELECT vec_id AS id FROM embeddings)
{_REACH}, degree AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept
FROM comp LEFT JOIN degree ON a = id
"""


@register("op2_embedding_dedup", _OP2_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of one label whose cosine is 0.93 or more, over all embeddings."""
    from .op2_rotation_codes import near_vectors

    return near_vectors(table(spark, sf, "embeddings"))


_OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, hex,
             CAST(CAST(unhex(hex) AS BIT) AS VARCHAR) AS bits, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, CAST(i * 5 + j + 1 AS BIGINT), 1) AS BIGINT)
                                       * CAST(pow(2, 4 - j) AS BIGINT)))::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""


@register("op9_warc", _OP9_SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """All pages as WARC records in ZIP packages, read back by byte range."""
    from .common import shared_folder
    from .op9_zip_warc import read_packages, write_packages

    packages = write_packages(table(spark, sf, "pages"), shared_folder(spark, "warc"))
    out = read_packages(spark, packages, with_payload=False)

    def number(c: str):
        return F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")

    return out.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                      number("refers_to").alias("refers_to"))


@register("op1_decontamination")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items found in whole documents, verbatim or with other numbers, units and names."""
    from .op1_templates import find_leaks

    out = find_leaks(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return out.select("doc_id", "item_id", "kind", "coverage", "matched_words", "slots")


@register("op4_sentencepiece")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents encoded to pieces and decoded again."""
    from .op4_piece_lattice import default_model, encode

    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = encode(docs, default_model(spark), verify=True)
    return out.select("doc_id", "ids", F.size("ids").alias("n_pieces"), "round_trip")


@register("op7_html_text")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Visible text of all pages, laid out with block spacing, lists and aligned table cells."""
    from .op7_layout_text import visible_text

    out = visible_text(table(spark, sf, "pages").select("page_id", "html"))
    return out.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


def quoted_mail(conversations: DataFrame) -> DataFrame:
    """The conversations as mail: each message quotes the turn before it, which quotes the one before that.

    The given table has no quotes; these follow from all of its rows.
    """
    base = conversations.select("conv_id", "turn", "role", "text")
    past = base.where("text is not null").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("p"))
    one = past.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("p.role").alias("r1"), F.col("p.text").alias("t1"))
    two = past.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("p.role").alias("r2"), F.col("p.text").alias("t2"))
    quote = F.concat_ws("\n", F.concat(F.coalesce("r1", F.lit("someone")), F.lit(" wrote:")),
                        F.when(F.col("t2").isNotNull(), F.concat(F.lit("> "), F.coalesce("r2", F.lit("someone")), F.lit(" wrote:\n> > "),
                                                                 F.replace(F.col("t2"), F.lit("\n"), F.lit("\n> > ")))),
                        F.concat(F.lit("> "), F.replace(F.col("t1"), F.lit("\n"), F.lit("\n> "))))
    return (base.join(one, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left")
            .select("conv_id", "turn", "role", F.when(F.col("t1").isNull() | F.col("text").isNull(), F.col("text"))
                    .otherwise(F.concat(quote, F.lit("\n\n"), F.col("text"))).alias("text")))


_OP10_SQL = """
WITH RECURSIVE b AS (
    SELECT conv_id, turn, role, text, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS whole FROM conversations),
up AS (SELECT x.conv_id, x.turn, max(y.turn) AS parent_turn
       FROM b x JOIN b p ON p.conv_id = x.conv_id AND p.turn = x.turn - 1
       JOIN b y ON y.conv_id = x.conv_id AND y.turn < x.turn AND y.whole = p.whole GROUP BY ALL),
chain(conv_id, turn, cur, depth) AS (
    SELECT conv_id, turn, turn, 0 FROM b
    UNION ALL SELECT c.conv_id, c.turn, u.parent_turn, depth + 1
    FROM chain c JOIN up u ON u.conv_id = c.conv_id AND u.turn = c.cur),
root AS (SELECT conv_id, turn, arg_max(cur, depth) AS root_turn, max(depth) AS depth FROM chain GROUP BY ALL)
SELECT b.conv_id, b.turn, b.role, b.text AS body,
       (p1.turn IS NOT NULL)::INT + (p1.turn IS NOT NULL AND p2.turn IS NOT NULL)::INT AS n_quotes,
       (p1.turn IS NOT NULL)::BIGINT + (p1.turn IS NOT NULL AND p2.turn IS NOT NULL)::BIGINT AS n_linked,
       parent_turn, NULL::BIGINT AS source_conv_id, NULL::BIGINT AS source_turn, root_turn, depth,
       row_number() OVER (PARTITION BY b.conv_id ORDER BY root_turn, b.turn) AS position
FROM b LEFT JOIN up USING (conv_id, turn) JOIN root USING (conv_id, turn)
LEFT JOIN b p1 ON p1.conv_id = b.conv_id AND p1.turn = b.turn - 1
LEFT JOIN b p2 ON p2.conv_id = b.conv_id AND p2.turn = b.turn - 2
"""


@register("op10_quote_threads", _OP10_SQL)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes of all conversations, as mail, linked to their messages; conversations in reply order without them."""
    from .op10_quote_threads import link_quotes

    return link_quotes(quoted_mail(table(spark, sf, "conversations")))


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text of ASCII characters, bit by bit."""
    chars = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::UBIGINT)"
    bits = ("list_reduce(list_concat([xor(c, b)], range(8)::UBIGINT[]), lambda v, k: "
            "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)")
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {chars}), lambda c, b: {bits}), 4294967295::UBIGINT)"


def _field_sql(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree_sql(name: str) -> str:
    """All levels of the trees over ``{name}0(g, pos, n, hash)``, and every node's siblings."""
    return f"""
{name}(g, level, pos, n, hash) AS (
    SELECT g, 0, pos, n, hash FROM {name}0
    UNION ALL SELECT g, level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(hash, '' ORDER BY pos))
    FROM {name} WHERE n > 1 GROUP BY g, level, pos // 3),
{name}_steps AS (SELECT x.g, x.level, x.pos,
    coalesce(string_agg(y.hash, '' ORDER BY y.pos) FILTER (WHERE y.pos < x.pos), '') AS lo,
    coalesce(string_agg(y.hash, '' ORDER BY y.pos) FILTER (WHERE y.pos > x.pos), '') AS hi
    FROM {name} x JOIN {name} y ON x.g = y.g AND x.level = y.level AND x.pos // 3 = y.pos // 3
    WHERE x.n > 1 GROUP BY ALL)"""


_OP11_SQL = f"""
WITH RECURSIVE l AS (SELECT doc_id, coalesce('s' || source, 'n') AS g, {_leaf_sql('text')} AS leaf,
    CASE WHEN {_crc32_sql('doc_id::VARCHAR')} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")}
         ELSE {_leaf_sql('text')} END AS altered FROM documents),
a0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n,
              leaf AS hash, doc_id, altered FROM l),
{_tree_sql('a')},
sub AS (SELECT g AS of, hash AS subroot FROM a WHERE n = 1),
b0 AS (SELECT '' AS g, row_number() OVER (ORDER BY encode(of)) - 1 AS pos, count(*) OVER () AS n, subroot AS hash, of FROM sub),
{_tree_sql('b')},
steps AS (SELECT x.doc_id, s.level, s.lo, s.hi FROM a0 x JOIN a_steps s ON s.g = x.g AND s.pos = x.pos // pow(3, s.level)::BIGINT
    UNION ALL SELECT x.doc_id, 1000 + s.level, s.lo, s.hi FROM a0 x JOIN b0 y ON y.of = x.g
    JOIN b_steps s ON s.pos = y.pos // pow(3, s.level)::BIGINT),
proofs AS (SELECT doc_id, list(struct_pack(lo := lo, hi := hi) ORDER BY level) AS path FROM steps GROUP BY doc_id),
folded(doc_id, k, hash) AS (
    SELECT doc_id, 0, altered FROM a0
    UNION ALL SELECT f.doc_id, k + 1, sha256(path[k + 1].lo || hash || path[k + 1].hi)
    FROM folded f JOIN proofs p ON p.doc_id = f.doc_id WHERE k < len(path)),
ends AS (SELECT doc_id, arg_max(hash, k) AS folded_root FROM folded GROUP BY doc_id)
SELECT x.doc_id, x.hash AS leaf, subroot, r.hash AS root,
       sha256(coalesce(list_reduce(list_concat([''], list_transform(path, lambda p: p.lo || p.hi)), lambda s, t: s || t), '')) AS proof_sha256,
       folded_root, folded_root = r.hash AS verified
FROM a0 x JOIN sub ON sub.of = x.g CROSS JOIN (SELECT hash FROM b WHERE n = 1) r
JOIN ends ON ends.doc_id = x.doc_id LEFT JOIN proofs ON proofs.doc_id = x.doc_id
"""


@register("op11_merkle_manifest", _OP11_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """Merkle proofs of all documents, and which of them hold after half have lost their line ends."""
    from .op11_bitmap_merkle import COLUMNS, fold_path, leaf_hash, proof_digest, prove

    whole = [F.col(c) for c in COLUMNS[:-1]]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0,
                      F.unhex(leaf_hash(*whole, F.replace(F.col("text"), F.lit("\n"), F.lit("")))))
    out = prove(table(spark, sf, "documents"), altered=tampered)
    folded = fold_path(F.coalesce("altered", "leaf"), F.col("path"))
    return (out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                       folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


@register("op13_token_counts")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every whole text of documents, counted by byte-pair merges."""
    from .op13_heap_merges import count_tokens, default_vocabulary

    return count_tokens(table(spark, sf, "documents"), default_vocabulary(spark), limit=1024)


_OP12_SQL = """
WITH v AS (
    SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS INT) AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, y.vec_id, a.label = y.label AS same, list_inner_product(a.e, y.e)::BIGINT AS score
      FROM v a JOIN v y ON y.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@register("op12_hard_negatives", _OP12_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, against all embeddings."""
    from .op12_bond_negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    vectors = table(spark, sf, "embeddings").withColumn("label", label)
    return mine(vectors, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95)
