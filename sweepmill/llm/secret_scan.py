"""Secret scanning with an incremental blob ledger (DataFrame functions only).

Every version of every path is addressed by the SHA-256 of its content. The ledger holds which (blob, rule, rule
version) triples have been scanned and what was found; an increment scans only triples that the ledger lacks, and
findings are joined back to every path that ever held the blob. Raising a rule's version rescans the blobs for
that rule alone.

Defined results: a null text is the empty blob; spans count code points, the end is exclusive; rows that repeat an
id or a text are reported alike; columns named like a result column are replaced.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and do not overlap; those whose `group` has fewer than `least`
    characters are dropped after matching."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


# The base kinds in their listed order, then the kinds that this scanner adds.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
EXTRA_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + EXTRA_RULES
LEDGER_SCHEMA = "blob string, kind string, version int, spans array<struct<start:long,stop:long>>"


def _pieces(text, rule: Rule):
    """Array of (gap, length, width) of a rule's matches in their order: characters since the match before, of the match
    and of its group."""
    pattern = F.lit(rule.pattern)

    def sizes(parts):
        return F.transform(parts, lambda x: F.length(x).cast("long"))

    whole = sizes(F.regexp_extract_all(text, pattern, F.lit(0)))
    width = sizes(F.regexp_extract_all(text, pattern, F.lit(rule.group))) if rule.group else whole
    between = F.slice(sizes(F.split(text, rule.pattern, -1)), F.lit(1), F.size(whole))
    # One pass settles the many texts without a match.
    return F.when(text.rlike(rule.pattern), F.arrays_zip(between.alias("gap"), whole.alias("length"), width.alias("width"))).otherwise(
        F.array().cast("array<struct<gap:long,length:long,width:long>>")
    )


def address(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the content address `blob` of each text."""
    return docs.withColumn("blob", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def scan_unseen(paths: DataFrame, ledger: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger rows that an increment adds: the blobs of paths (see address) under the rules, without the
    (blob, kind, version) triples that the ledger holds. One path stands for all paths of a blob, so the text moves
    once and spreads by its own id, however often a blob recurs."""
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    first = paths.groupBy("blob").agg(F.min(id_col).alias("_first"))
    triples = first.select("blob", "_first", F.explode(wanted).alias("_r")).select("blob", "_first", "_r.kind", "_r.version")
    unseen = triples.join(ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
    todo = unseen.groupBy("blob", "_first").agg(F.collect_set("kind").alias("_kinds"))
    texts = paths.select(F.col(id_col).alias("_first"), "blob", F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    work = texts.join(todo, texts["_first"].eqNullSafe(todo["_first"]) & (texts["blob"] == todo["blob"])).select(texts["blob"], "_text", "_kinds")
    found = F.array(*[
        F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"),
                 F.when(F.array_contains("_kinds", r.kind), _pieces(F.col("_text"), r)).alias("pieces")) for r in rules
    ])
    rows = work.select("blob", F.explode(found).alias("f")).where("f.pieces IS NOT NULL").select("blob", "f.*")
    key = ["blob", "kind", "version"]
    each = rows.dropDuplicates(key).select(*key, "least", F.posexplode_outer("pieces").alias("place", "m"))
    stop = F.sum(F.col("m.gap") + F.col("m.length")).over(Window.partitionBy(*key).orderBy("place"))
    span = F.when(F.col("m.width") >= F.col("least"), F.struct((F.col("stop") - F.col("m.length")).alias("start"), "stop"))
    return each.withColumn("stop", stop).groupBy(*key).agg(F.array_sort(F.collect_list(span)).alias("spans"))


class BlobLedger:
    """A ledger in a folder: increments are appended to one Parquet table, which is rewritten, sorted by blob, after every
    `fanout` of them. A small table beside it says which folder holds now, so a reader never meets half of either."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 16):
        self.spark, self.fanout = spark, fanout
        self.path = path or f"{common.scratch_root(spark)}/sweepmill-{uuid.uuid4().hex}/blobs"

    def _now(self) -> tuple[str, int] | None:
        if not common.exists(self.spark, f"{self.path}/listed"):
            return None
        row = self.spark.read.parquet(f"{self.path}/listed").orderBy("version", ascending=False).first()
        return (row["folder"], row["increments"]) if row else None

    def _list(self, folder: str, increments: int) -> None:
        row = self.spark.createDataFrame([(folder, increments)], "folder string, increments int").withColumn("version", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/listed")

    def read(self) -> DataFrame:
        now = self._now()
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(f"{self.path}/{now[0]}") if now else self.spark.createDataFrame([], LEDGER_SCHEMA)

    def append(self, rows: DataFrame) -> None:
        folder, increments = self._now() or (uuid.uuid4().hex, 0)
        with common.settings(self.spark, common.STASHING):
            rows.write.mode("append").parquet(f"{self.path}/{folder}")
        self._list(folder, increments + 1)
        if increments + 1 >= self.fanout:
            self.compact()

    def compact(self) -> None:
        old, new = self._now(), uuid.uuid4().hex
        if old:
            self.read().repartition("blob").sortWithinPartitions("blob").write.parquet(f"{self.path}/{new}")
            self._list(new, 0)
            common.delete(self.spark, f"{self.path}/{old[0]}")


def _joined(spans, kinds):
    """kind:start:stop in order of start, then of kind as listed, joined by commas."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    rows = F.transform(F.filter(spans, lambda s: s["kind"].isin(list(kinds))), lambda s: F.struct(s["start"], rank[s["kind"]].alias("rank"), s["stop"], s["kind"]))
    return F.array_join(F.transform(F.array_sort(rows), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def report(paths: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """Findings joined back to every path: n_<base kind>, base_sha256, spans; paths keep their other columns."""
    asked = F.lit(False)
    for r in rules:
        asked = asked | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    current = ledger.where(asked)
    kinds = [r.kind for r in rules]
    base = [r.kind for r in BASE_RULES]
    flat = F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(F.col("kind").alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))))
    held = common.unused(paths, "_spans")
    found = current.where(F.size("spans") > 0).groupBy("blob").agg(flat.alias(held))
    out = paths.join(found, "blob", "left")
    spans = F.coalesce(F.col(held), F.array().cast("array<struct<kind:string,start:long,stop:long>>"))
    counts = [F.size(F.filter(spans, _is_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    digest = F.sha2(_joined(spans, base).cast("binary"), 256).alias("base_sha256")
    return out.select(*[F.col(f"`{c}`") for c in paths.columns], *counts, digest, _joined(spans, kinds).alias("spans"))


def scan_secrets(docs: DataFrame, rules=RULES, ledger: BlobLedger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The report on docs, once what the ledger lacks of them has been scanned and added to it. Without a ledger, a new
    one in the scratch folder serves."""
    docs = common.without(docs, "blob", "base_sha256", "spans", *[f"n_{r.kind}" for r in BASE_RULES])
    ledger = ledger or BlobLedger(docs.sparkSession)
    paths = address(docs, text_col)
    ledger.append(scan_unseen(paths, ledger.read(), rules, id_col, text_col))
    return report(paths.drop(text_col), ledger.read(), rules)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = BlobLedger(spark)
    # A base and an increment: the second call scans only blobs that the first one has not met.
    scan_secrets(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), ledger=ledger)
    return scan_secrets(docs, ledger=ledger).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def _sql_kind(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, {rank} AS rank, unnest(list_transform(range(1, len(w) + 1), lambda i: struct_pack(
           start := coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0),
           width := length(w[i]), value := length(v[i])))) AS m
  FROM (SELECT doc_id, regexp_extract_all(t, '{quoted}') AS w, regexp_extract_all(t, '{quoted}', {group}) AS v,
               string_split_regex(t, '{quoted}') AS g
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
  WHERE len(w) > 0"""


_SQL_ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_SQL_SPANS = " UNION ALL ".join(
    _sql_kind(kind, i, pattern, group, least) + ""
    for i, (kind, pattern, group, least) in enumerate((
        ("assign", _SQL_ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]{16,}", 0, 1), ("hex", "[0-9a-f]{24,}", 0, 1),
        ("private_key", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
        ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ))
)
OP5_SQL = f"""
WITH found AS ({_SQL_SPANS}),
good AS (
  SELECT doc_id, kind, rank, m.start AS start, kind || ':' || m.start::BIGINT || ':' || (m.start + m.width)::BIGINT AS span
  FROM found WHERE kind <> 'assign' OR m.value >= 6)
SELECT d.doc_id, (count(*) FILTER (WHERE kind = 'assign'))::BIGINT AS n_assign, (count(*) FILTER (WHERE kind = 'access'))::BIGINT AS n_access,
       (count(*) FILTER (WHERE kind = 'hex'))::BIGINT AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM documents d LEFT JOIN good g ON d.doc_id = g.doc_id GROUP BY d.doc_id
"""
