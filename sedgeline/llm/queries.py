"""The registered query of each operator: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from .chat import canonical_turns, format_chats, loss_texts, read_turns
from .decontaminate import decontaminate, is_contaminated
from .language import fit_languages, identify
from .lattice import score_texts
from .line_rules import apply_rules, base_failed, fit_rules, is_kept
from .ngram_jaccard import ngram_jaccard_join
from .packing import pack
from .quality import crc_mod, fit_quality, score_quality
from .resampling import resample
from .secrets import joined, scan_secrets, whole_matches
from .substrings import remove_repeats
from .toxicity import fit_toxicity, score_toxicity
from .vector_codes import encode, fit_codebooks, label_errors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL["op1_ngram_jaccard"] = f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWERED}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS ss FROM w),
x AS MATERIALIZED (SELECT doc_id, len(ss) AS n, unnest(ss) AS sh FROM s),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.node = p.a)
SELECT r.doc_id, CAST(any_value(len(s.ss)) AS BIGINT) AS n_shingles, min(r.node) AS component_id
FROM r JOIN s ON r.doc_id = s.doc_id GROUP BY r.doc_id
"""


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", whole_matches(F.col("secrets.spans")).alias("spans"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    c = decontaminate(docs, table(spark, sf_dir, "benchmark"), size=13)
    items = F.col("contamination.items")
    return c.select(
        "doc_id", "contamination.n_words", "contamination.n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


ORACLE_SQL["op5_decontamination"] = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT n FROM bw),
dw AS MATERIALIZED (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN l ON len(w) >= n)),
h AS MATERIALIZED (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    score = F.col("quality_score.score")
    return score_quality(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_texts(docs, tokenizer_path("piece_bpe_32k.model"), crc_mod("doc_id", 7) != 2)
    return out.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = fit_toxicity(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    score = F.col("toxicity.score")
    return score_toxicity(docs, index).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


@query
def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    field = fit_rules(docs, table(spark, sf_dir, "labels"))
    return apply_rules(docs, field).select("doc_id", *(f"rules.{c}" for c in counts), base_failed().alias("base_failed"), is_kept().alias("kept"))


@query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row is a record of the layout of one turn; its mapping is chosen by fingerprint as any other's."""
    same = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.sql(f"SELECT -1L, 0L, 'user', '{same}' UNION ALL SELECT -1L, 1L, 'assistant', '{same}'"))
    record = F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"})
    turns = canonical_turns(rows.select("conv_id", "turn", record.alias("record")))
    turns = turns.select("conv_id", "turn", F.posexplode("chat.turns").alias("at", "said")).select("conv_id", "turn", "at", "said.role", "said.text")
    out = format_chats(turns, order_cols=("turn", "at"))
    read, lost = read_turns(F.col("formatted")), F.array_join(loss_texts(F.col("formatted"), F.col("loss_mask")), "")
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.select("conv_id", "formatted", read.alias("read"), lost.alias("lost"))
    return out.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.col("lost"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL["op9_chat_formatting"] = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|(?:INST|SYS|OUT|TURN|BODY)\]))', '\1\\\2\3', 'g')) AS n,
    CASE role WHEN 'user' THEN 4 WHEN 'system' THEN 3 WHEN 'assistant' THEN 3 ELSE 4 END AS m,
    CASE WHEN role IN ('user', 'system', 'assistant') THEN 0 ELSE length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|(?:INST|SYS|OUT|TURN|BODY)\]))', '\1\\\2\3', 'g')) + 6 END AS r
  FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + 2 * m + r + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), size=200, keep_bytes=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE_SQL["op4_suffix_dedup"] = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199)) AS i FROM d)),
r AS (SELECT doc_id, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
g AS (SELECT doc_id, i, sum(CASE WHEN i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r)),
s AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, g),
e AS (SELECT doc_id, a, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p FROM (SELECT doc_id, a, b FROM s UNION ALL SELECT doc_id, length(x) // 2, length(x) // 2 FROM d)),
k AS (SELECT d.doc_id, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY p, a) AS x FROM e JOIN d ON e.doc_id = d.doc_id GROUP BY d.doc_id),
n AS (SELECT doc_id, sum(b - a) AS n, count(*) AS k FROM s GROUP BY doc_id)
SELECT d.doc_id, length(d.x) // 2 AS n_bytes, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, coalesce(n.k, 0) AS n_spans, sha256(unhex(k.x)) AS kept_sha256
FROM d JOIN k ON d.doc_id = k.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = fit_codebooks(vectors)
    coded = encode(vectors, books).select("vec_id", "label", "vector_code.code", "vector_code.error")
    out = label_errors(Scratch(spark, "vector_codes").save(coded, "coded"))
    return out.select("vec_id", "code", "error", "label_error", F.sha2(F.lit(books.text()), 256).alias("codebooks_sha256"))


def _codes_sql(rounds: int = 4) -> str:
    """Rounds one after the other; sums of products of integers are exact in doubles here."""
    near = "SELECT p.vec_id, p.part, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT p.vec_id, p.part, b.e, p.s - 2 * list_inner_product(p.v, b.v) + b.s AS d FROM p JOIN b{i} b ON p.part = b.part) p GROUP BY p.vec_id, p.part"
    steps = []
    for i in range(rounds):
        steps.append(f"""a{i} AS MATERIALIZED ({near.format(i=i)}),
m{i} AS MATERIALIZED (SELECT part, e, list(x ORDER BY pos) AS v FROM (
  SELECT part, e, pos, CAST((s - ((s % n) + n) % n) // n AS DOUBLE) AS x FROM (
    SELECT a.part, a.e, pos, CAST(sum(p.v[pos]) AS HUGEINT) AS s, count(*) AS n FROM a{i} a JOIN p ON a.vec_id = p.vec_id AND a.part = p.part, range(1, 17) t(pos) GROUP BY a.part, a.e, pos)) GROUP BY part, e),
b{i + 1} AS MATERIALIZED (SELECT part, e, v, list_inner_product(v, v) AS s FROM (SELECT b.part, b.e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m ON b.part = m.part AND b.e = m.e))""")
    return f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v, list_inner_product(v, v) AS s FROM (SELECT vec_id, part, v[16 * part + 1:16 * part + 16] AS v FROM k, range(4) t(part))),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v, s FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256)),
{",".join(steps)},
f AS MATERIALIZED ({near.format(i=rounds)}),
c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY vec_id),
h AS (SELECT sha256(string_agg(t, ',' ORDER BY part, e)) AS h FROM (SELECT part, e, array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS t FROM b{rounds}))
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM c JOIN k ON c.vec_id = k.vec_id, h
"""


ORACLE_SQL["op11_vector_codes"] = _codes_sql()


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 by bytes over a table of 256 values that the first step builds
ORACLE_SQL["op12_importance_resampling"] = f"""
WITH crc AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS MATERIALIZED (SELECT regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
x AS MATERIALIZED (SELECT doc_id, unnest(w) AS w FROM d),
y AS MATERIALIZED (SELECT unnest(w) AS w FROM b),
k AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT)),
    lambda c, o: xor(t[1 + (xor(c, o) & 255)], c >> 8), 4294967295), 4294967295) % 10000 AS k
  FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM x UNION SELECT w FROM y)), crc),
s AS (SELECT k, count(*) AS s FROM x JOIN k ON x.w = k.w GROUP BY k),
t AS (SELECT k, count(*) AS t FROM y JOIN k ON y.w = k.w GROUP BY k),
g AS MATERIALIZED (
  SELECT k.k, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * CAST((SELECT count(*) FROM x) + 10000 AS DOUBLE) / ((coalesce(s, 0) + 1) * CAST((SELECT count(*) FROM y) + 10000 AS DOUBLE)))) AS BIGINT) AS g
  FROM (SELECT DISTINCT k FROM k) k LEFT JOIN s ON k.k = s.k LEFT JOIN t ON k.k = t.k),
v AS (SELECT doc_id, count(*) AS n, sum(g) AS g FROM x JOIN k ON x.w = k.w JOIN g ON k.k = g.k GROUP BY doc_id),
r AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(g, 0) AS BIGINT) AS weight,
    CAST(coalesce(g, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || d.doc_id)[1:8] AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN v ON d.doc_id = v.doc_id),
o AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS o FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN o <= (SELECT count(*) FROM r WHERE n_features >= 20) * 10 // 100 THEN o END AS rank FROM o
"""


@query
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = fit_languages(docs, crc_mod("doc_id", 4) != 2)
    found = identify(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
