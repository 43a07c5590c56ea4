"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_stable_projection_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_and_read

    return archive_and_read(_table(spark, sf_dir, "pages"), min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what it was judged by; keep is false for those rejected."""
    from .quality import judge

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return judge(docs, _table(spark, sf_dir, "labels"), keep_text=False).select("doc_id", "source", "lang", "verdict.*")


def op5_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op6_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import link_classes

    return link_classes(_table(spark, sf_dir, "documents"), shingle=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), width=50, with_text=False)


def op7_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import describe_media, media_of_texts

    return describe_media(media_of_texts(_table(spark, sf_dir, "documents")))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_conversations, read_back

    own = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    tricky = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digests(read_back(format_conversations(own.unionByName(tricky))))


#: Weights of the production mix: the documents carry no domain, so a source's last digit deals it to one of four.
MIX_WEIGHTS = {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0, "d0/en": 2.0, "d1/en": 2.0}


def mix_domain() -> "F.Column":
    return F.concat(F.lit("d"), F.pmod(F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.lit(0)), F.lit(4)).cast("string"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import materialise
    from .mixing import count_words, mix_sources

    docs = materialise(_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", count_words(F.col("text")).alias("n_tokens")))
    mixed = mix_sources(docs, MIX_WEIGHTS, fraction=0.8, max_epochs=2, domain=mix_domain(), tokens=F.col("n_tokens"))
    return mixed.select("doc_id", "mix.domain", "mix.lang", "mix.source", "mix.epoch", "n_tokens")


QUERIES = {f.__name__: f for f in (op1_stable_projection_ann, op2_warc_index, op3_best_fit_packing, op4_quality_classifier, op5_deleted_interpolation, op6_partenum_join, op7_jpeg_media, op8_chat_formatting, op9_mixing, op10_suffix_array_dedup)}


# ---------------------------------------------------------------- SQL

_WORDS = "[^\\x20\\x09-\\x0D]+"


def _filled(name: str, nodes: str, parent: str) -> str:
    """SQL of water filling: nodes (domain, lang, source, supply, cap, weight, pb) with budgets, within each parent."""
    part = f"PARTITION BY {parent}" if parent else ""
    before = f"OVER ({part} ORDER BY cap / weight, domain NULLS FIRST, lang NULLS FIRST, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{name}_l AS (SELECT *, (pb - coalesce(sum(cap) {before}, 0)) / (sum(weight) OVER ({part}) - coalesce(sum(weight) {before}, 0)) AS lev, row_number() OVER ({part} ORDER BY cap / weight, domain NULLS FIRST, lang NULLS FIRST, source NULLS FIRST) AS nth FROM ({nodes}) WHERE cap > 0 AND weight > 0),
{name} AS (SELECT domain, lang, source, supply, coalesce(least(cap, weight * arg_min(lev, nth) FILTER (WHERE lev * weight < cap) OVER ({part})), cap) AS budget FROM {name}_l)"""


def _weight(path: str) -> str:
    return "CASE " + path + " " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in MIX_WEIGHTS.items()) + " ELSE 1.0::DOUBLE END"


OP9_SQL = f"""WITH d AS (SELECT doc_id, lang, source, 'd' || coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) % 4 AS domain, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS BIGINT) AS n FROM documents),
leaf AS (SELECT domain, lang, source, sum(n)::BIGINT AS supply, 2.0::DOUBLE * sum(n)::DOUBLE AS cap FROM d GROUP BY ALL),
{_filled("one", f"SELECT domain, NULL AS lang, NULL AS source, sum(supply)::BIGINT AS supply, sum(cap) AS cap, {_weight("coalesce(domain, 'null')")} AS weight, (SELECT least(sum(cap), sum(supply)::DOUBLE * 0.8::DOUBLE) FROM leaf) AS pb FROM leaf GROUP BY domain", "")},
{_filled("two", f"SELECT n.domain, n.lang, NULL AS source, n.supply, n.cap, {_weight("concat_ws('/', coalesce(n.domain, 'null'), coalesce(n.lang, 'null'))")} AS weight, u.budget AS pb FROM (SELECT domain, lang, sum(supply)::BIGINT AS supply, sum(cap) AS cap FROM leaf GROUP BY domain, lang) n JOIN one u ON n.domain IS NOT DISTINCT FROM u.domain", "domain")},
{_filled("three", f"SELECT n.domain, n.lang, n.source, n.supply, n.cap, {_weight("concat_ws('/', coalesce(n.domain, 'null'), coalesce(n.lang, 'null'), coalesce(n.source, 'null'))")} AS weight, u.budget AS pb FROM leaf n JOIN two u ON n.domain IS NOT DISTINCT FROM u.domain AND n.lang IS NOT DISTINCT FROM u.lang", "domain, lang")},
ends AS (SELECT *, floor(budget / supply)::BIGINT AS whole, floor(budget - floor(budget / supply) * supply)::BIGINT AS rest FROM three),
every AS (SELECT d.*, whole, rest, sum(n) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('17:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) RANGE UNBOUNDED PRECEDING) AS upto FROM d JOIN ends e ON d.domain IS NOT DISTINCT FROM e.domain AND d.lang IS NOT DISTINCT FROM e.lang AND d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, domain, lang, source, epoch::INT AS epoch, n AS n_tokens FROM (SELECT *, unnest(range(2)) AS epoch FROM every) WHERE epoch < whole OR (epoch = whole AND upto <= rest)"""

_DIGITS = "array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha1(html), 10 * g + 1, 10))::BIGINT >> (35 - 5 * j)) & 31)::INT, 1) for j in range(8)], '')"
OP2_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, array_to_string([{_DIGITS} for g in range(4)], '') AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to FROM q"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP6_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 2) + 1)) AS i FROM w WHERE len(ws) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * m >= 90 * (cx.n + cy.n - m)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
SELECT w.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(l.low, w.doc_id)) AS component_id FROM w LEFT JOIN c USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x) l USING (doc_id)"""

OP8_SQL = r"""WITH c AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
(3 + sum(11 + length(role || text) + length(regexp_replace(role || text, '[^~<\[\]]', '', 'g'))))::BIGINT AS formatted_chars,
regexp_full_match(string_agg(role, '>' ORDER BY turn NULLS FIRST, role, text), '(system>)?user>assistant(>user>assistant)*') AS valid FROM c GROUP BY conv_id"""

OP10_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, (2 * i + 1)::INT, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
low AS (SELECT g, min(doc_id) AS low FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, i FROM w JOIN low USING (g) WHERE low.low < doc_id),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM gone)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, (2 * before + 1)::INT, (2 * (a - before))::INT), '' ORDER BY a) AS head, max(b) AS stop FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, (2 * coalesce(stop, 0) + 1)::INT))) AS kept_sha256 FROM d LEFT JOIN kept k USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {"op2_warc_index": OP2_SQL, "op6_partenum_join": OP6_SQL, "op8_chat_formatting": OP8_SQL, "op9_mixing": OP9_SQL, "op10_suffix_array_dedup": OP10_SQL}
