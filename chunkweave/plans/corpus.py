"""The test tables read as a corpus of files, chunks, placements and requests, in Spark and in SQL.

file: a document, path source/<id>.txt; chunk: 512 bytes; heat: 1 / file_id^0.7; placement B: by the
fingerprint's first digits, none where its last digit is f; request: an event's user's document.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.functions.chunking import fixed_chunks
from chunkweave.operators import catalog, dedup
from chunkweave.staging import written

CHUNK, NODES, WINDOW, BATCH = 512, 10, 16, 4


class Corpus:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def contents(self) -> DataFrame:
        d = self.table("documents")
        path = F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt"))
        return d.select(path.alias("path"), "doc_id", F.encode("text", "UTF-8").alias("content"))

    @property
    def sizes(self) -> DataFrame:
        return self.contents.select("path", "doc_id", F.octet_length("content").cast("long").alias("raw_size"))

    @cached_property
    def _files(self) -> Callable[[], DataFrame]:
        """Numbered once for each corpus; the table is written then."""
        return written(catalog.with_file_ids(self.sizes), "files")

    @property
    def files(self) -> DataFrame:
        return self._files()

    @property
    def chunks(self) -> DataFrame:
        return fixed_chunks(self.contents.select("path", "content"), CHUNK)

    @property
    def numbered_chunks(self) -> DataFrame:
        return self.chunks.join(self.files.select("path", "file_id"), "path")

    @cached_property
    def _kept_chunks(self) -> Callable[[], DataFrame]:
        return written(self.numbered_chunks, "chunks")

    @property
    def kept_chunks(self) -> DataFrame:
        """numbered_chunks, cut and written once: for plans that read them again and again."""
        return self._kept_chunks()

    @property
    def counts(self) -> DataFrame:
        """files with n_chunks and heat."""
        n = self.chunks.groupBy("path").agg(F.count("*").alias("n_chunks"))
        return self.heat.join(n, "path", "left").na.fill(0, ["n_chunks"])

    @cached_property
    def _ids(self) -> Callable[[], DataFrame]:
        return written(catalog.chunk_ids(self.chunks), "ids")

    @property
    def ids(self) -> DataFrame:
        return self._ids()

    @property
    def heat(self) -> DataFrame:
        return catalog.zipf_heat(self.files, 0.7)

    @property
    def placement(self) -> DataFrame:
        """(fp, node_ref) of placement B."""
        fps = self.chunks.select("fp").distinct().where(F.substring("fp", 40, 1) != "f")
        node = F.conv(F.substring("fp", 1, 8), 16, 10).cast("long") % NODES + 1
        return fps.select("fp", F.concat(F.lit("edge"), node.cast("string")).alias("node_ref"))

    @property
    def nodes(self) -> DataFrame:
        return self.spark.range(1, NODES + 1).select(F.col("id").cast("int").alias("node"), F.concat(F.lit("edge"), F.col("id").cast("string")).alias("id"))

    @property
    def marked(self) -> DataFrame:
        return dedup.marked(self.chunks)

    @property
    def placed(self) -> DataFrame:
        return dedup.place_by_table(catalog.first_seen(self.chunks), self.placement, self.nodes)

    @property
    def index(self) -> DataFrame:
        return self.placed.select("fp", "node")

    @property
    def requests(self) -> DataFrame:
        e, n = self.table("events"), self.table("documents").count()
        docs = self.sizes.select("doc_id", F.col("path").alias("input"))
        first = e.agg(F.min("ts").alias("t0"))
        rows = e.join(F.broadcast(first), F.lit(True)).select(F.col("event_id").alias("req_id"), (F.col("user_id") % n).alias("doc_id"), F.round(F.timestamp_diff("MICROSECOND", F.col("t0"), F.col("ts")) / 1e6, 6).alias("arrival_s"))
        return rows.join(docs, "doc_id").select("req_id", "arrival_s", "input")


_CTES = {
    "d": "SELECT doc_id, text, source || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt' AS path, hex(encode(text)) AS h, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents",
    "files": "SELECT row_number() OVER (ORDER BY path) AS file_id, path, doc_id, n AS raw_size FROM d",
    "chunks": f"SELECT path, CAST(i AS BIGINT) AS seq, CAST(i * {CHUNK} AS BIGINT) AS off, sha1(unhex(substr(h, CAST(i * {2 * CHUNK} + 1 AS BIGINT), {2 * CHUNK}))) AS fp, CAST(length(substr(h, CAST(i * {2 * CHUNK} + 1 AS BIGINT), {2 * CHUNK})) // 2 AS BIGINT) AS length FROM d, unnest(range(0, CAST(ceil(n / {CHUNK}.0) AS BIGINT))) u(i) WHERE n > 0",
    "firsts": "SELECT fp, path, seq, length FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY path, seq) AS rn FROM chunks) WHERE rn = 1",
    "ids": "SELECT row_number() OVER (ORDER BY path, seq) AS chunk_id, fp, length AS size, path, seq FROM firsts",
    "heat": "SELECT *, 1.0 / pow(file_id, 0.7) AS heat, CASE WHEN raw_size > 0 THEN 1.0 / pow(file_id, 0.7) / raw_size ELSE 0.0 END AS heat_dsize FROM files",
    "counts": "SELECT h.*, coalesce(c.n_chunks, 0) AS n_chunks FROM heat h LEFT JOIN (SELECT path, count(*) AS n_chunks FROM chunks GROUP BY path) c USING (path)",
    "placed": f"SELECT fp, path, seq, length, CAST(CASE WHEN substr(fp, 40, 1) <> 'f' THEN CAST('0x' || substr(fp, 1, 8) AS BIGINT) % {NODES} + 1 ELSE 0 END AS INTEGER) AS node FROM firsts",
    "marked": "SELECT c.*, (c.path = f.path AND c.seq = f.seq) AS is_unique FROM chunks c JOIN firsts f USING (fp)",
    "requests": "SELECT event_id AS req_id, round(epoch_us(ts) / 1e6 - (SELECT min(epoch_us(ts)) FROM events) / 1e6, 6) AS arrival_s, d.path AS input FROM events e JOIN d ON d.doc_id = e.user_id % (SELECT count(*) FROM documents)",
    "fstats": """SELECT m.path, count(*) AS chunks, CAST(sum(m.length) AS BIGINT) AS original_bytes, CAST(sum(CASE WHEN is_unique THEN m.length ELSE 0 END) AS BIGINT) AS unique_bytes,
        count(*) FILTER (is_unique AND node = 0) AS cloud_only_unique_chunks, CAST(sum(CASE WHEN is_unique AND node = 0 THEN m.length ELSE 0 END) AS BIGINT) AS cloud_only_unique_bytes,
        CAST(sum(CASE WHEN NOT is_unique THEN 0 WHEN node > 0 THEN 2 * m.length ELSE m.length END) AS BIGINT) AS network_sent_bytes
        FROM marked m JOIN (SELECT fp, node FROM placed) p USING (fp) GROUP BY m.path""",
    "policy": f"SELECT c.path, count(*) AS chunks, CAST(sum(c.length) AS BIGINT) AS bytes, count(*) FILTER (NOT node BETWEEN 1 AND {NODES}) AS non_edge FROM chunks c JOIN (SELECT fp, node FROM placed) p USING (fp) GROUP BY c.path",
    "wdist": f"SELECT path, seq // {WINDOW} AS \"window\", fp, min(seq) AS first_seq, count(*) AS uses, max(length) AS length FROM chunks GROUP BY ALL",
    "fetched": f"SELECT w.path, w.\"window\", node, count(*) AS chunks, CAST(sum(w.length) AS BIGINT) AS bytes, CAST(ceil(count(*) / {BATCH}.0) AS BIGINT) AS batches FROM wdist w JOIN (SELECT fp, node FROM placed) p USING (fp) GROUP BY ALL",
    "cover": """SELECT c.path, count(*) AS total_chunks, count(*) FILTER (node > 0) AS edge_chunks, CAST(sum(c.length) AS BIGINT) AS total_bytes, CAST(coalesce(sum(c.length) FILTER (node > 0), 0) AS BIGINT) AS edge_bytes
        FROM chunks c JOIN (SELECT fp, node FROM placed) p USING (fp) GROUP BY c.path""",
    "classed": "SELECT *, edge_bytes / total_bytes AS edge_ratio, CASE WHEN edge_bytes = total_bytes THEN 'full' WHEN edge_bytes > 0 THEN 'partial' ELSE 'none' END AS class FROM cover",
    "use": "SELECT file_id, fp, max(length) AS size, count(*) AS uses FROM chunks JOIN files USING (path) GROUP BY ALL",
    "pairs": "SELECT a.file_id AS u, b.file_id AS v, count(*) AS shared_chunks, CAST(sum(a.size) AS BIGINT) AS shared_bytes FROM use a JOIN use b ON a.fp = b.fp AND a.file_id < b.file_id GROUP BY ALL",
}


def sql(needs: str, body: str) -> str:
    """body behind the definitions that it needs, named in order; a body that starts with a comma defines more."""
    return "WITH " + ",\n".join(f"{n} AS ({_CTES[n]})" for n in needs.split()) + "\n" + body


#: FNV-1a of a fingerprint's characters, 64 bits.
FNV = """list_reduce(list_prepend(CAST(14695981039346656037 AS UBIGINT), list_transform(string_split(fp, ''), lambda x: CAST(ascii(x) AS UBIGINT))), lambda h, b: CAST((CAST(xor(h, b) AS UHUGEINT) * 1099511628211) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT))"""
#: Jump hash of every distinct fingerprint, a row for each jump.
JUMPED = sql("d chunks", f""", k AS (SELECT fp, {FNV} AS h FROM (SELECT DISTINCT fp FROM chunks)),
j(fp, h, bucket, nxt) AS (SELECT fp, h, CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM k
UNION ALL SELECT fp, n, nxt, CAST(floor((nxt + 1) * (2147483648.0 / CAST((n >> 33) + 1 AS DOUBLE))) AS BIGINT)
FROM (SELECT *, CAST((CAST(h AS UHUGEINT) * 2862933555777941757 + 1) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT) AS n FROM j WHERE nxt < {NODES}))
""").replace("WITH d AS", "WITH RECURSIVE d AS", 1)


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """Queries, their oracles, and the decorator that adds one."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}

    def query(name: str, oracle: str | None = None):
        def add(f: Callable[[Corpus], DataFrame]):
            queries[name] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
            if oracle:
                oracles[name] = oracle
            return f

        return add

    return queries, oracles, query


def r6(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]
