"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.align import align_tokenizers
from sedimenta.llm.ann import nearest
from sedimenta.llm.chat import format_chats, unescape
from sedimenta.llm.decontaminate import find_contamination
from sedimenta.llm.linededup import drop_lines, html_lines, url_host
from sedimenta.llm.merkle import build_manifest, fold, leaf_digest, prove
from sedimenta.llm.neardup import near_duplicates
from sedimenta.llm.packing import pack_documents
from sedimenta.llm.quality import classify
from sedimenta.llm.repeats import remove_repeats
from sedimenta.llm.secrets import BASE_RULES, scan_secrets
from sedimenta.llm.sharding import assign_shards
from sedimenta.llm.warc import read_archives, write_archives
from sedimenta.sources.scratch import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, k=10)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    done = format_chats(rows)
    masked = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    said = F.array_join(masked, "")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"),
        F.sha2(said.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), written AS (
  SELECT *, CASE WHEN regexp_matches(role || chr(10) || text, '</?turn>|\\[lnb]') OR contains(role, chr(10))
    THEN replace(replace(replace(text, '\', '\b'), '<turn>', '\lturn>'), '</turn>', '\l/turn>') ELSE text END AS body
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn>') + length(role) + 1 + length(body) + length('</turn>')) + count(*) - 1 AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign_shards(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = pack_documents(docs, tokenizer_path(), derive={"ids_crc32": F.crc32("ids").cast("long")}, keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), n=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM b, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM grams), runs AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(i)
), hits AS (SELECT doc_id, i, runs.size, item FROM runs JOIN grams USING (size, gram)),
words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, size)) AS t(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM hits WHERE item IS NOT NULL GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = [r.kind for r in BASE_RULES]
    found = scan_secrets(docs)

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(of(k) for k in base),
        F.sha2(written(F.filter("secrets", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        written(F.col("secrets")).alias("spans"),
    )


def op5_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), n=5, percent=85)


def op6_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "p_content", "p_page", "p_good", "keep")


def op7_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=50)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    lined = pages.select("page_id", url_host("url").alias("host"), html_lines("html").alias("text"))
    done = drop_lines(lined, "host", "text", max_ratio=0.1, min_pages=2)
    return done.select("page_id", "host", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(url, '^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    regexp_replace(html, '[ \t\r\n]*(?:<[^>]*>|\n)[ \t\r\n]*', chr(10), 'g') AS text FROM pages
), l AS (
  SELECT page_id, host, i, line, trim(line, ' ') AS word FROM (
    SELECT page_id, host, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM (SELECT page_id, host, string_split(text, chr(10)) AS lines FROM p))
), totals AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
often AS (
  SELECT host, word FROM l JOIN totals USING (host) WHERE word <> '' AND host <> ''
  GROUP BY host, word, pages HAVING count(DISTINCT page_id) >= 2 AND count(DISTINCT page_id) > 0.1 * pages
), marked AS (SELECT l.*, often.word IS NOT NULL AS gone FROM l LEFT JOIN often ON often.host = l.host AND often.word = l.word)
SELECT page_id, host, count(*) FILTER (WHERE word <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY page_id, host
"""


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return align_tokenizers(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op13_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder, key="page_id", url="url", payload="html", least=1000)
    return read_archives(spark, folder).select(
        F.col("key").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT *, strlen(body) AS size, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, size AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN size >= 1000 AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM g
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plain = ["doc_id", "source", "lang", "n_chars"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaves = docs.select("doc_id", "source", leaf_digest([*plain, "text"]).alias("digest"), F.when(tampered, leaf_digest([*plain, lowered])).alias("altered"))
    proofs = prove(build_manifest(leaves, "source", ["doc_id"], "digest", keep=["doc_id", "altered"]), ["doc_id", "altered"])
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), "")
    folded = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), fold(F.coalesce("altered", "leaf"), "steps").alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def _merkle_sql(levels: int = 6) -> str:
    """Trees of up to 16 ** levels nodes, level by level: a tree of one node is carried on as it is."""

    def digest(text: str) -> str:
        fields = (f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", text))
        return f"sha256({' || '.join(fields)})"

    crc = "xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT), lambda c, b: list_reduce([xor(c, b)] || [i::UBIGINT for i in range(8)], lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"
    parts = [
        f"a AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, {digest('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {digest('low')} END AS altered FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents))",
        "s AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM a)",
        "s0 AS (SELECT tree, i, leaf AS d FROM s)",
    ]

    def climb(name: str) -> None:
        for k in range(levels):
            run = "OVER (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN"
            parts.append(f"{name}{k}x AS (SELECT tree, i, d, count(*) OVER (PARTITION BY tree) AS n, coalesce(string_agg(d, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(d, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS f FROM {name}{k})")
            parts.append(f"{name}{k + 1} AS (SELECT tree, i // 16 AS i, CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE max(d) END AS d FROM {name}{k}x GROUP BY tree, i // 16)")

    climb("s")
    parts.append(f"r AS (SELECT tree AS t, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS j FROM s{levels})")
    parts.append("r0 AS (SELECT 'all' AS tree, j AS i, subroot AS d FROM r)")
    climb("r")
    parts.append("p0 AS (SELECT doc_id, leaf, tree AS t, i, j, subroot, coalesce(altered, leaf) AS h, '' AS proof FROM s JOIN r ON r.t = s.tree)")
    last = "p0"
    for name, at in (("s", "i"), ("r", "j")):
        for k in range(levels):
            on = f"x.tree = {'p.t' if name == 's' else chr(39) + 'all' + chr(39)} AND x.i = p.{at} // {16**k}"
            parts.append(f"{name}p{k} AS (SELECT p.* REPLACE (CASE WHEN n > 1 THEN sha256(b || h || f) ELSE h END AS h, proof || b || f AS proof) FROM {last} p JOIN {name}{k}x x ON {on})")
            last = f"{name}p{k}"
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = d AS verified FROM {last} p, r{levels}"


QUERIES = {f.__name__: f for f in (op1_hilbert_ann, op2_chat_format, op3_minimax_shards, op4_slack_packing, op5_circulant_minhash, op6_cotrained_quality, op7_prefix_free_dedup, op8_decontaminate, op9_line_dedup, op10_secret_scan, op11_merkle_manifest, op12_tokenizer_alignment, op13_warc_archives)}
ORACLE_SQL = {"op2_chat_format": OP2_SQL, "op8_decontaminate": OP8_SQL, "op9_line_dedup": OP9_SQL, "op11_merkle_manifest": _merkle_sql(), "op13_warc_archives": OP13_SQL}
