"""N-gram Jaccard self-join with token-combination prefixes.

A document is the set of its distinct k-word shingles, here "tokens", each a 64-bit hash. Two documents link when
den * |intersection| >= num * |union|.

Prefixes. A set of n tokens may lack at most e = n - ceil(num * n / den) of its tokens in a partner. Tokens are
ordered by class, rare before frequent, then by hash. A token is frequent when more than `rare_max` distinct sets have
it in their region, the first tokens of a set by hash, somewhat more than a prefix; any function of the token would
be correct, this one bounds the posting lists of single tokens. A set with e + extra rare tokens indexes those alone,
and two sets of which at least one is such must share `extra` of them: the prefix is extended so that one chance token
is not enough to make a candidate. Sets whose region has too few rare tokens look at all their tokens. Where rare tokens
run out, frequent ones follow, and they are indexed as pairs: they fall into J sub-classes by hash, a sub-class
with p prefix tokens gives its p(p-1)/2 pairs and covers p - 1, and the prefix is extended until rare tokens and covers
reach e + 1, so partners must share a rare token or a pair. J follows the set's size, which keeps the pairs in
proportion to it; sets near a step of J index both steps.

Candidates. Sets that share signatures are first paired with one hub for each signature, in proportion to the rows.
Verified hubs are contracted; only signatures that still hold several components give further candidates, each
member outside the largest one with the others, as far as the counts of their rare tokens and, for pairs of frequent
ones, their sketches allow a link at all: a sketch has one bit for each of 512 classes of tokens, odd or even, and two
sets differ in at least as many tokens as their sketches in bits, so no link is lost. Nothing in one component is paired again, so large groups of near copies cost their hub pairs, and no link between
components is missed. Candidates are verified on whole sets.

Rows. Texts are tokenised where they lie; what moves is a row of three numbers for each signature (the signature, the
set, its sizes in one number), and whole sets only of candidates. Signatures that one set alone has go before anything
is joined. A set has a number of its own; equal sets, told apart by 128 bits, are one from the start.

Defined results: a null, empty or blank text has no shingles and links with nothing; a null id is reported with
component null if alone and never names a component, but its text links like others; rows that repeat an id
are separate texts under it; columns other than id and text are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph

#: Keys of 8 bytes each are sent to all executors up to this many (8 MB); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
SKETCH = [f"s{i}" for i in range(8)]
_U = np.uint64


class Measure:
    """The threshold num / den, at least 1/2, and what follows from it for a set of n tokens (an int, or a column)."""

    def __init__(self, num: int, den: int, extra: int):
        assert den <= 2 * num <= 2 * den, "thresholds from 1/2 to 1"
        self.num, self.den, self.extra = num, den, extra

    def lacks(self, n: int) -> int:
        return n - -(-self.num * n // self.den)

    def need(self, n: int) -> int:
        return min(n, self.lacks(n) + self.extra)

    def region(self, n: int) -> int:
        """Tokens looked at first: a fifth more than the prefix."""
        need = self.need(n)
        return min(n, max(32, need + need // 5 + 16))

    def need_and_region(self, n):
        """The same of a column."""
        need = F.least(n, n - F.ceil(n * self.num / self.den) + self.extra)
        return need, F.least(n, F.greatest(F.lit(32), need + F.floor(need / 5) + 16))

    def classes(self, n: int) -> int:
        return 1 << max(0, (self.lacks(n) + 1).bit_length() - 1)

    def steps(self, n: int) -> list[int]:
        """J of this size and of all larger sizes that can link with it."""
        j, last, out = self.classes(n), self.classes(n * self.den // self.num), []
        while j <= last:
            out.append(j)
            j *= 2
        return out


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        sums = [common.mix64(tokens ^ _U(s)).sum(dtype=np.uint64) + _U(len(tokens)) for s in (0xA5A5_1234_5678_9ABC, 0x3C6E_F372_FE94_F82B)]
    return tuple(common.mix64(np.array(sums)).view(np.int64).tolist())


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of an Arrow array of lists of longs."""
    return column.offsets.to_numpy(), column.values.to_numpy()


def _set_rows(k: int, of):
    """A mapInArrow function over rows with _text: the record batch that of(rows, their token sets) gives, a chunk of rows
    at a time."""

    def run(batches):
        for batch in batches:
            texts = batch.column("_text")
            for part in common.text_chunks(texts):
                size = part.stop - part.start
                words, at = common.word_hashes(texts.slice(part.start, size))
                yield of(batch.slice(part.start, size), [np.unique(common.shingles(words[at[i] : at[i + 1]], k)) for i in range(size)])

    return run


def _described(measure: Measure):
    def of(rows, sets):
        keys = np.array([_digest(t) for t in sets], dtype=np.int64)
        sizes = np.array([len(t) for t in sets], dtype=np.int64)
        columns = [rows.column("_id"), rows.column("_tkey"), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sizes)]
        columns.append(_lists([t[: measure.region(len(t))] for t in sets]))
        return pa.RecordBatch.from_arrays(columns, names=["_id", "_tkey", "h1", "h2", "n", "region"])

    return of


def _with_tokens(rows, sets):
    keys = np.array([_digest(t) for t in sets], dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), _lists(sets)], names=["h1", "h2", "tokens"])


def _small(keys: DataFrame) -> DataFrame:
    """A table of one long column, with a broadcast hint if it is known to be short."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, tokens (all, sorted) of the wanted nodes, from one text of each."""
    facts = nodes.select("node", "h1", "h2", "_tkey").join(wanted.select("node").distinct(), "node")
    keys = common.stash(facts, "wanted")
    texts = docs.select("_tkey", "_text").join(_small(keys.select("_tkey").distinct()), "_tkey").select("_text")
    rows = texts.mapInArrow(_set_rows(k, _with_tokens), "h1 long, h2 long, tokens array<long>")
    return rows.dropDuplicates(["h1", "h2"]).join(keys.select("node", "h1", "h2"), ["h1", "h2"]).select("node", "tokens")


def _short(nodes: DataFrame, hits: DataFrame, measure: Measure) -> DataFrame:
    """node: those whose region has too few rare tokens and is not the whole set. hits: node, token, the frequent ones."""
    need, region = measure.need_and_region(F.col("n"))
    counted = hits.groupBy("node").agg(F.count("*").alias("f")).join(nodes.select("node", "n"), "node")
    return counted.where((region < F.col("n")) & (region - F.col("f") < need)).select("node")


def _signature_rows(measure: Measure):
    """mapInArrow: node, n, tokens (of a region or of the whole set), often (the frequent ones) -> sig, node, info."""

    def singles(tokens):
        return common.mix64(tokens ^ _U(0x51D3_0000_0000_0001)) | _U(1)

    def pairs(tokens, j):
        part = common.mix64(tokens ^ _U(0x77)) & _U(j - 1)
        order = np.lexsort((tokens, part))
        part, tokens = part[order], tokens[order]
        size = np.unique(part, return_counts=True)[1]
        left, right, at = [], [], 0
        for m in size:
            x, y = np.triu_indices(m, 1)
            left.append(x + at)
            right.append(y + at)
            at += m
        left, right = np.concatenate(left), np.concatenate(right)
        return common.mix64(tokens[left] * _U(0xD6E8FEB86659FD93) + tokens[right] * _U(3) + _U(j)) & ~_U(1)

    def covered(tokens, j, wanted):
        """The least number of leading tokens whose sub-classes cover `wanted`."""
        part = common.mix64(tokens ^ _U(0x77)) & _U(j - 1)
        gain = np.ones(len(tokens), dtype=np.int64)
        gain[np.unique(part, return_index=True)[1]] = 0
        return min(len(tokens), int(np.searchsorted(np.cumsum(gain), wanted)) + 1)

    def of(n, tokens, often):
        frequent = np.isin(tokens, often)
        rare = len(tokens) - int(frequent.sum())
        need, wanted = measure.need(n), measure.lacks(n) + 1 - rare
        parts = [singles(tokens[~frequent][:need])]
        if wanted > 0 and rare < len(tokens):
            own = tokens[frequent]
            parts.append(np.unique(np.concatenate([pairs(own[: covered(own, j, wanted)], j) for j in measure.steps(n)])))
        return np.concatenate(parts), (n << 32) | (rare << 1) | int(rare >= need)

    def run(batches):
        for batch in batches:
            nodes, sizes = batch.column("node").to_numpy(), batch.column("n").to_pylist()
            at, tokens = _flat(batch.column("tokens"))
            begin, often = _flat(batch.column("often"))
            tokens, often, out, infos = tokens.view(np.uint64), often.view(np.uint64), [], []
            for i, n in enumerate(sizes):
                sigs, info = of(n, tokens[at[i] : at[i + 1]], often[begin[i] : begin[i + 1]])
                out.append(sigs)
                infos.append(info)
            if out:
                counts = [len(x) for x in out]
                columns = [np.concatenate(out).view(np.int64), np.repeat(nodes, counts), np.repeat(np.array(infos, dtype=np.int64), counts)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sig", "node", "info"])

    return run


def _sketches(batches):
    """mapInArrow: node, tokens -> node, s0 .. s7: whether each class of tokens has an odd number."""
    for batch in batches:
        at, tokens = _flat(batch.column("tokens"))
        tokens = common.mix64(tokens.view(np.uint64) ^ _U(0x2545_F491_4F6C_DD1D)) & _U(511)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(at))
        bits = np.bincount(owner * 512 + tokens[at[0] : at[-1]].astype(np.int64), minlength=batch.num_rows * 512) & 1
        words = np.packbits(bits.astype(np.uint8).reshape(-1, 512), axis=1).view(np.int64).reshape(-1, 8)
        yield pa.RecordBatch.from_arrays([batch.column("node"), *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(8)]], names=["node", *SKETCH])


def _repeated(batches):
    """mapInArrow over rows sorted by sig: pairs, and the singles that a neighbouring row has too. The last row of a batch
    waits for the next one."""
    last, seen = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        sig = rows.column("sig").to_numpy()
        same = sig[1:] == sig[:-1]
        keep = np.concatenate(([seen], same)) | np.concatenate((same, [False])) | (sig & 1 == 0)
        last, seen = rows.slice(len(sig) - 1), bool(same[-1]) if len(same) else seen
        yield rows.slice(0, len(sig) - 1).filter(pa.array(keep[:-1]))
    if last is not None and (seen or last.column("sig")[0].as_py() & 1 == 0):
        yield last


def _signatures(docs: DataFrame, nodes: DataFrame, measure: Measure, k: int, rare_max: int) -> tuple[DataFrame, DataFrame]:
    """sig (odd: a single token, even: a pair), node, info (n, count of rare tokens, whether these suffice) of all nodes
    that share a token with another in what they look at; and sketches (node, s0 .. s7) of those that may have pairs."""

    def frequent(rows: DataFrame) -> DataFrame:
        return rows.groupBy("token").agg(F.count("*").alias("sets")).where(F.col("sets") > rare_max).select("token")

    post = nodes.select("node", F.explode("region").alias("token"))
    first = common.stash(frequent(post), "often")
    deep = common.stash(_short(nodes, post.join(_small(first), "token"), measure), "short")
    # Nodes that look at whole sets meet tokens that no region has counted, so these are counted among them; what is
    # frequent anywhere is frequent for all. That can leave further nodes without enough rare tokens.
    sets = common.stash(_sets_of(docs, nodes, deep, k), "deep")
    often = common.stash(first.unionByName(frequent(sets.select(F.explode("tokens").alias("token")))).distinct(), "often")
    hits = common.stash(post.join(_small(often), "token").join(deep, "node", "left_anti"), "hits")
    late = common.stash(_short(nodes, hits, measure), "late")
    more = common.stash(_sets_of(docs, nodes, late, k), "late sets")
    whole = sets.unionByName(more)
    hits = hits.join(late, "node", "left_anti").unionByName(whole.select("node", F.explode("tokens").alias("token")).join(_small(often), "token").select("node", "token"))
    seen = nodes.select("node", F.col("region").alias("tokens")).join(whole.select("node"), "node", "left_anti").unionByName(whole)
    ready = (
        seen.join(hits.groupBy("node").agg(F.collect_list("token").alias("often")), "node", "left").join(nodes.select("node", "n"), "node")
        .select("node", "n", "tokens", F.coalesce("often", F.array().cast("array<long>")).alias("often"))
    )
    kinds = "sig long, node long, info long"
    rows = ready.mapInArrow(_signature_rows(measure), kinds)
    # Rare tokens have few rows each; a pair may have any number, so its rows are dealt out further.
    salt = F.when(F.col("sig") % 2 == 0, F.col("node") % 64).otherwise(0)
    out = common.stash(rows.repartition("sig", salt).sortWithinPartitions("sig").mapInArrow(_repeated, kinds), "signatures")
    # Pairs come from nodes that have looked at whole sets.
    sketches = seen.join(nodes.select("node", "n"), "node").where(F.size("tokens") == F.col("n")).join(hits.select("node").distinct(), "node", "left_semi")
    sketches = common.stash(sketches.select("node", "tokens").mapInArrow(_sketches, "node long, " + ", ".join(f"{c} long" for c in SKETCH)), "sketches")
    common.unstash(first, deep, sets, often, late, more)
    return out, sketches


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, measure: Measure, k: int) -> DataFrame:
    """Of the pairs a, b of nodes, those whose whole sets link."""
    pairs = common.stash(pairs, "pairs")
    sets = common.stash(_sets_of(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")), k), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("common"))
    links = common.stash(both.where(measure.den * F.col("common") >= measure.num * (F.col("total") - F.col("common"))).select("a", "b"), "links")
    common.unstash(pairs, sets)
    return links


def _facts(info):
    """n, count of rare tokens, and whether these suffice, of an info column."""
    return F.shiftright(info, 32), F.shiftright(info.bitwiseAND(F.lit(0xFFFF_FFFF)), 1), info.bitwiseAND(F.lit(1)) == 1


def _enough(c, singles, p, q, measure: Measure):
    """Whether nodes of infos p and q that share c signatures, singles of them tokens, can link.

    A set that is not full has indexed all its rare tokens, so two of these lack in one another what they do not share."""
    (n, rare, full), (m, rare2, full2) = _facts(p), _facts(q)
    small, large = F.least(n, m), F.greatest(n, m)
    least = F.least(F.lit(measure.extra), F.ceil(F.lit(measure.num) * small / measure.den))
    most = F.least(n - rare + singles, m - rare2 + singles)  # of the intersection
    reach = measure.den * most >= measure.num * (n + m - most)
    return (measure.den * small >= measure.num * large) & F.when(full | full2, singles >= least).otherwise((c >= 1) & reach)


def _counted(met: DataFrame, measure: Measure) -> DataFrame:
    """a, b of the rows a, p, b, q, sig that are enough."""
    each = met.groupBy("a", "p", "b", "q").agg(F.count("*").alias("c"), F.count_if(F.col("sig") % 2 != 0).alias("singles"))
    return each.where(_enough(F.col("c"), F.col("singles"), F.col("p"), F.col("q"), measure)).select("a", "b")


def _hub_pairs(sigs: DataFrame, measure: Measure) -> DataFrame:
    """Each node with the hub of each of its signatures: the set with the smallest share of rare tokens, which of a
    group of copies is the one nearest to all others."""
    n, rare, _ = _facts(F.col("info"))
    rows = sigs.withColumn("step", F.floor(F.log(n) / F.log(F.lit(measure.den / measure.num + 1e-9))).cast("int"))
    hubs = rows.groupBy("sig", "step").agg(F.min(F.struct((rare / n).alias("share"), "node", "info")).alias("hub"), F.count("*").alias("rows")).where("rows > 1")
    met = rows.join(hubs.select("sig", "step", F.col("hub.node").alias("b"), F.col("hub.info").alias("q")), ["sig", "step"]).where("node <> b")
    return _counted(met.select(F.col("node").alias("a"), F.col("info").alias("p"), "b", "q", "sig"), measure)


def _cross_pairs(sigs: DataFrame, sketches: DataFrame, comps: DataFrame, measure: Measure) -> DataFrame:
    """The pairs between components that signatures still hold together.

    Two sets that are not full and share no rare token can link only if the rare tokens of both are few. Those with
    more than half of what a pair may have ("heavy") therefore need not meet one another by frequent tokens."""
    rows = sigs.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = rows.groupBy("sig", "component").agg(F.count("*").alias("m"))
    mixed = parts.groupBy("sig").agg(F.max(F.struct("m", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    n, rare, _ = _facts(F.col("info"))
    heavy = (F.col("sig") % 2 == 0) & (2 * measure.num * rare > (measure.den - measure.num) * n)
    mixed = rows.join(mixed.select("sig", F.col("main.component").alias("main")), "sig").select("sig", "node", "info", "component", "main", heavy.alias("heavy"))
    mixed = common.stash(mixed.join(sketches, (F.col("sig") % 2 == 0) & (mixed["node"] == sketches["node"]), "left").drop(sketches["node"]), "mixed")
    s, o = mixed.where("component <> main").alias("s"), mixed.alias("o")
    (n, rare, _), (m, rare2, _) = _facts(F.col("s.info")), _facts(F.col("o.info"))
    fits = (measure.den * F.least(n, m)) >= (measure.num * F.greatest(n, m))
    most = F.least(n - rare, m - rare2)  # of the intersection, without a rare token
    few = (F.col("s.sig") % 2 != 0) | ((measure.den + measure.num) * most >= measure.num * (n + m))
    once = (F.col("o.component") == F.col("o.main")) | (F.col("s.node") < F.col("o.node"))
    apart = sum((F.bit_count(F.col(f"s.{c}").bitwiseXOR(F.col(f"o.{c}"))) for c in SKETCH[1:]), F.bit_count(F.col("s.s0").bitwiseXOR(F.col("o.s0"))))
    near = F.coalesce((measure.den + measure.num) * apart <= (measure.den - measure.num) * (n + m), F.lit(True))
    good = (F.col("s.sig") == F.col("o.sig")) & (F.col("s.component") != F.col("o.component")) & once & fits & few & near
    swap = F.col("s.node") < F.col("o.node")
    cols = [F.when(swap, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")).alias(name) for x, y, c, name in (("s", "o", "node", "a"), ("s", "o", "info", "p"), ("o", "s", "node", "b"), ("o", "s", "info", "q"))]
    light = s.join(o.where("NOT heavy"), good).select(*cols, "s.sig")
    other = s.where("NOT heavy").join(o.where("heavy"), good).select(*cols, "s.sig")
    return _counted(light.unionByName(other), measure)


def jaccard_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, rare_max: int = 8, extra: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the id, n_shingles (long), component_id (the smallest id reachable by links,
    itself included) and set_id (long, null without shingles), equal for equal sets."""
    measure = Measure(num, den, extra)
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_tkey", F.xxhash64("_text"))
    kind = docs.schema["_id"].dataType.simpleString()
    prep = docs.mapInArrow(_set_rows(k, _described(measure)), f"_id {kind}, _tkey long, h1 long, h2 long, n long, region array<long>")
    prep = common.stash(prep, "prep")
    members = common.stash(prep.select("_id", "h1", "h2", "n"), "members")
    nodes = prep.where("n > 0").groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in ("n", "_tkey", "region")], F.min("_id").alias("root"))
    nodes = common.stash(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    common.unstash(prep)
    sigs, sketches = _signatures(docs, nodes, measure, k, rare_max)
    near = _verified(docs, nodes, _hub_pairs(sigs, measure), measure, k)
    comps = graph.components(near)
    far = _verified(docs, nodes, _cross_pairs(sigs, sketches, comps, measure), measure, k)
    if far.take(1):
        comps = graph.components(near.unionByName(far))
    common.unstash(sigs, sketches)
    roots = nodes.select("node", "h1", "h2", "root").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = roots.groupBy("component").agg(F.min("root").alias("component_id"))
    named = roots.join(least, "component").select("h1", "h2", "node", "component_id")
    out = members.join(named, ["h1", "h2"], "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"), F.col("node").alias("set_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_groups(docs, k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")
