"""Registered queries of the operators, with SQL twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lm_scoring
from .ann import build_index, nearest
from .common import read
from .decontaminate import contamination
from .html_extract import extract_pages
from .manifest import verify_documents
from .mixing import mix
from .pii import personal_data
from .secrets import BASE_KINDS, RULES, Rule, secret_report
from .sharding import plan_tree, shard_documents
from .simhash import near_duplicates
from .toxicity import score_documents
from .variants import spelling_variants
from .warc import archive_round_trip

QUERIES = {}
TWINS = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            TWINS[name] = sql
        return fn

    return register


@query("op4_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"))


@query("op5_ann")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return nearest(build_index(vectors), vectors.where("vec_id % 50 = 0"), k=5)


@query("op7_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")


_ENTITIES = "parts[i]"
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&")):
    _ENTITIES = f"replace({_ENTITIES}, '&{_name};', '{_char}')"


# what the pages of the given tables are made of: one article of h1, p, b and br, five named characters
@query("op8_html", f"""
WITH bodies AS (SELECT row_number() OVER () AS r, page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages),
cut AS (SELECT r, list_transform(string_split_regex(body, '<(/?p|/?h1|br)(\\s[^>]*)?>'), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS parts FROM bodies),
blocks AS (SELECT r, i, trim(regexp_replace({_ENTITIES}, '\\s+', ' ', 'g')) AS block FROM (SELECT r, parts, unnest(generate_series(1, len(parts))) AS i FROM cut)),
texts AS (SELECT r, string_agg(block, chr(10) ORDER BY i) AS text FROM blocks WHERE block <> '' GROUP BY r)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM bodies LEFT JOIN texts USING (r)""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


@query("op9_lm_scoring")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness to the documents labelled as good, against all documents."""
    good = read(spark, sf_dir, "labels").where("quality = 1")
    return lm_scoring.score_documents(read(spark, sf_dir, "documents"), good)


@query("op1_sharding")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(read(spark, sf_dir, "documents"), plan_tree(16))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v{i} >> {s}) & 31) + 1, 1)"
    for i in range(8) for s in (15, 10, 5, 0)
)
_GROUPS = ", ".join(f"CAST('0x' || substr(h, {5 * i + 1}, 5) AS INTEGER) AS v{i}" for i in range(8))


@query("op2_warc", f"""
WITH hashed AS (
    SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
           sha1(coalesce(html, '')) AS h FROM pages),
named AS (SELECT page_id, payload_bytes, {_GROUPS} FROM hashed),
digests AS (SELECT page_id, payload_bytes, {_B32} AS payload_digest FROM named),
firsts AS (SELECT payload_digest, min(page_id) AS origin FROM digests GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> origin THEN origin END AS refers_to
FROM digests JOIN firsts USING (payload_digest)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(read(spark, sf_dir, "pages"))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


_WORDS = "regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"


@query("op10_decontaminate", f"""
WITH item_words AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format(x="text")} AS w
    FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
    SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(
        generate_series(1, greatest(1, len(w) - 9)), lambda i: array_to_string(w[i : i + least(len(w), 10) - 1], ' '))) AS win
    FROM item_words WHERE len(w) > 0),
doc_words AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(x="coalesce(text, '')")} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
    SELECT r, n, unnest(generate_series(1, len(w) - n + 1)) AS i, w FROM doc_words, lengths WHERE len(w) >= n),
cut AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM doc_windows),
hits AS (SELECT r, cut.n, i, item_id FROM cut JOIN item_windows USING (win)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (
    SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT r, n, i FROM hits)) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


def _crc32(codes: str) -> str:
    """CRC-32 of a list of byte values, bit by bit."""
    return (
        f"xor(list_reduce(flatten(list_transform({codes}, lambda b: [b::BIGINT, 0, 0, 0, 0, 0, 0, 0])), lambda c, x: "
        "xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)), 4294967295), 4294967295)"
    )


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f})) || ':' || {f}, '-')" for f in fields) + ")"


def _levels(leaves: str) -> str:
    """All levels of trees over ``leaves`` (tree, pos, h): tree, level, pos, h, n."""
    return f"""SELECT tree, 0 AS level, pos, h, count(*) OVER (PARTITION BY tree) AS n FROM {leaves}
    UNION ALL SELECT tree, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM {{self}}
    WHERE n > 1 GROUP BY tree, level, pos // 8, n"""


@query("op11_manifest", f"""
WITH RECURSIVE hashed AS (
    SELECT doc_id, lang, {_leaf("text")} AS leaf,
        CASE WHEN {_crc32("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: unicode(ch))")} % 3 = 0
        THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS altered FROM documents),
placed AS (SELECT *, row_number() OVER () AS r, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
leaves AS (SELECT tree, pos, leaf AS h FROM placed),
nodes AS ({_levels("leaves").format(self="nodes")}),
roots AS (SELECT 0 AS tree, tree AS pos, h FROM nodes WHERE n = 1),
tops AS ({_levels("roots").format(self="tops")}),
every AS (SELECT tree, level, pos, h FROM nodes UNION ALL SELECT -1, level + 100, pos, h FROM tops),
steps AS (
    SELECT r, p.tree AS tree, level, p.pos // CAST(8 ** level AS BIGINT) AS spot FROM placed p JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) USING (tree)
    UNION ALL SELECT r, -1, level + 100, p.tree // CAST(8 ** level AS BIGINT) FROM placed p, (SELECT DISTINCT level FROM tops WHERE n > 1)),
sides AS (
    SELECT r, s.level, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos < spot), '') AS lefts,
        coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos > spot), '') AS rights
    FROM steps s JOIN every e ON e.tree = s.tree AND e.level = s.level AND e.pos // 8 = s.spot // 8 GROUP BY r, s.level),
proofs AS (SELECT r, sha256(string_agg(lefts || rights, '' ORDER BY level)) AS proof FROM sides GROUP BY r),
turns AS (SELECT r, lefts, rights, row_number() OVER (PARTITION BY r ORDER BY level) AS turn FROM sides),
folds AS (SELECT r, 0 AS turn, coalesce(altered, leaf) AS acc FROM placed
    UNION ALL SELECT f.r, t.turn, sha256(lefts || acc || rights) FROM folds f JOIN turns t ON t.r = f.r AND t.turn = f.turn + 1),
ends AS (SELECT r, max_by(acc, turn) AS folded_root FROM folds GROUP BY r),
whole AS (SELECT h AS root FROM tops WHERE n = 1)
SELECT doc_id, leaf, s.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN roots s ON s.pos = p.tree JOIN ends USING (r) LEFT JOIN proofs USING (r), whole""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_documents(read(spark, sf_dir, "documents"))


_LOW = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BYTES = (  # UTF-8 of characters up to U+00FF
    "flatten(list_transform(string_split({x}, ''), lambda ch: "
    "CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)] END))"
)


@query("op12_variants", f"""
WITH RECURSIVE runs AS (
    SELECT id || ':' || run AS key, run, count(*) AS n FROM (
        SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_LOW.format(x="text")}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
    GROUP BY id, run),
hashed AS (SELECT run, n, {_crc32(_BYTES.format(x="key"))} AS h FROM runs),
spelt AS (
    SELECT CASE WHEN h % 97 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gaps AS (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words),
holes AS (SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS rest FROM gaps),
pairs AS (
    SELECT x.word AS word, y.word AS near, y.n AS near_n FROM holes x JOIN holes y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
    UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.rest
    UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.rest),
best AS (SELECT word, count(*) AS n_near, min((-near_n, near)) AS b FROM pairs GROUP BY word),
named AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * n THEN b[2] END AS form, CASE WHEN -b[1] >= 2 * n THEN -b[1] END AS form_n
    FROM words LEFT JOIN best USING (word)),
chains AS (SELECT word, form AS root, 1 AS steps FROM named WHERE form IS NOT NULL
    UNION ALL SELECT c.word, n.form, steps + 1 FROM chains c JOIN named n ON n.word = c.root WHERE n.form IS NOT NULL),
ends AS (SELECT word, max_by(root, steps) AS root FROM chains GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM named LEFT JOIN ends USING (word)""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))


def _matches(number: int, rule: Rule) -> str:
    """``r, kind, s, e`` of a rule's matches; RE2 reads the pattern."""
    pattern = "[0-9a-f]{16,}" if rule.kind == "hex" else rule.pattern
    pattern = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT r, {number} AS kind, s, s + length(hits[i]) AS e FROM (
        SELECT r, hits, vals, i, list_sum(list_transform(pieces[:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0)::BIGINT AS s
        FROM (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM (
            SELECT r, string_split_regex(t, {pattern}) AS pieces, regexp_extract_all(t, {pattern}) AS hits, regexp_extract_all(t, {pattern}, {rule.group}) AS vals
            FROM texts WHERE regexp_matches(t, {pattern})))) WHERE length(vals[i]) >= {rule.least}"""


_NAMES = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
_LISTING = f"coalesce(string_agg(({_NAMES})[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e){{}}, '')"


@query("op13_secrets", f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_matches(i, r) for i, r in enumerate(RULES))})
SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n_{k}" for i, k in enumerate(BASE_KINDS))},
    sha256({_LISTING.format(f" FILTER (WHERE kind < {len(BASE_KINDS)})")}) AS base_sha256, {_LISTING.format("")} AS spans
FROM texts LEFT JOIN found USING (r) GROUP BY r, doc_id""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(read(spark, sf_dir, "documents"))
