"""Prefix trie of conversations: what they share from the first turn on, and the tokens that sharing saves.

Turns become 128-bit digests with a word count; a prefix is named by its depth and a polynomial in the digests of its
turns, which can be added up piece by piece. Conversations that are equal throughout are one sequence with a weight, so
copies cost nothing. The sequences are hash-partitioned by the digest of their first turn, and tries of pointer
dictionaries are built inside applyInPandas, many first turns to a call, with an iterative postorder for what a subtree
adds up to. A first-turn subtrie of more than `most` turns is repartitioned by its next turn, and so on: cut where each
part below has `most` turns at most. That is where a prefix's turns, counted over its sequences, first fall to `most`, so
one aggregate finds all these cuts at once, however deep. The nodes above the cuts get their sums from those
below by pointer doubling, in as many rounds as the logarithm of their depth.

No conversation is gathered in a task: turns are sorted by range over all tasks, one pass numbers them, and what a
conversation that spans tasks has in the tasks before (one row for each at most two conversations of a task) is added after.
The ids that end in one node are joined in pieces by range of id, then streamed through SHA-256, which takes them in turn.

Defined results: turns are ordered by turn, null first, ties by role and text; null role or text is empty; rows that repeat
are turns of their own; turns with a null conversation id are left out; a conversation exists if it has a row. An empty
table has no nodes. Texts are told apart by 128 bits. Columns other than the four named are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Turns of a part of the trie that one call builds; what falls into a call on average.
MOST = 4096
#: Most turns that a conversation can take over from another one.
HEADS = 3
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NOBODY = hashlib.sha256(b"").hexdigest()
SUMS = ("q1", "q2")


def _power(base: int, exponent: np.ndarray) -> np.ndarray:
    """base ** exponent modulo 2^64 for an odd base; exponents may be negative."""
    out, left = np.ones(len(exponent), dtype=np.uint64), np.abs(exponent).astype(np.uint64)
    up, down = base % 2**64, pow(base, -1, 2**64)
    while left.any():
        factor = np.where(exponent < 0, np.uint64(down), np.uint64(up))
        out = np.where(left & np.uint64(1), out * factor, out)
        up, down, left = up * up % 2**64, down * down % 2**64, left >> np.uint64(1)
    return out


def _unsigned(column) -> np.ndarray:
    return np.asarray(column.fill_null(0) if isinstance(column, (pa.Array, pa.ChunkedArray)) else column).astype(np.int64).view(np.uint64)


def _batch(schema: str, **columns) -> pa.RecordBatch:
    """The columns in the order of the schema."""
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_pydict({n: columns[n].view(np.int64) if isinstance(columns[n], np.ndarray) and columns[n].dtype == np.uint64 else columns[n] for n in names})


PLACED = "c long, pos long, t1 long, t2 long, words long, q1 long, q2 long"
SPLICED = "c long, base long, head long, taken long, len long, " + ", ".join(f"{x}{i} long" for i in (1, 2) for x in ("off", "onto", "f", "g"))
NAMED = "rep long, depth long, len long, weight long, t1 long, t2 long, words long, g1 long, g2 long, ends string, p1 long, up1 long, p2 long, up2 long"
NODE = "depth long, p1 long, p2 long, up1 long, up2 long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def _numbered(batches):
    """Turns in order, with their place in what this task has of the conversation and the running polynomials there."""
    last, count, carry, task = None, 0, [np.uint64(0)] * 2, TaskContext.get().partitionId()
    for b in batches:
        c, n = b["c"].to_numpy(), b.num_rows
        if not n:
            continue
        first = np.concatenate(([c[0] != last], c[1:] != c[:-1]))
        begin = np.maximum.accumulate(np.where(first, np.arange(n), -1))
        place = np.arange(n) - begin + np.where(begin < 0, count - 1, 0)
        sums = []
        for i, base in enumerate(BASES):
            terms = _unsigned(b[f"t{i + 1}"]) * _power(base, place)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
            sums.append(total[1:] - total[np.maximum(begin, 0)] + np.where(begin < 0, carry[i], np.uint64(0)))
        last, count, carry = c[-1], int(place[-1]) + 1, [s[-1] for s in sums]
        yield _batch(f"task long, {PLACED}", c=c, task=np.full(n, task), pos=place, t1=_unsigned(b["t1"]), t2=_unsigned(b["t2"]), words=b["words"].to_numpy(), q1=sums[0], q2=sums[1])


def _moved(batches):
    """The same for the later pieces of a conversation: pos and polynomials behind what comes before."""
    for b in batches:
        before = b["before"].to_numpy()
        sums = {s: _unsigned(b[f"{s}_before"]) + _unsigned(b[s]) * _power(base, before) for s, base in zip(SUMS, BASES, strict=True)}
        yield _batch(PLACED, c=b["c"].to_numpy(), pos=b["pos"].to_numpy() + before, t1=_unsigned(b["t1"]), t2=_unsigned(b["t2"]), words=b["words"].to_numpy(), **sums)


def placed(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """c, pos (from 0), digest, words and running polynomials of each turn."""
    spark = turns.sparkSession
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    # Texts are shuffled only where several rows share a turn.
    tied = rows.groupBy("c", "turn").count().where("count > 1").select(F.col("c").alias("tied_c"), F.col("turn").alias("tied_turn"))
    tied = common.stash(tied, "tied")
    marked = rows.join(tied, (F.col("c") == F.col("tied_c")) & F.col("turn").eqNullSafe(F.col("tied_turn")), "left")
    digest = [F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit("second"), "role", "text").alias("t2")]
    ties = [F.when(F.col("tied_c").isNotNull(), F.col(x)).alias(x) for x in ("role", "text")]
    words = F.regexp_count("text", F.lit(common.WORD)).cast("long").alias("words")
    digests = common.stash(marked.select("c", "turn", *ties, *digest, words), "digests")
    ordered = digests.repartitionByRange("c", F.asc_nulls_first("turn"), "role", "text").sortWithinPartitions("c", F.asc_nulls_first("turn"), "role", "text")
    rows = common.stash(ordered.select("c", "t1", "t2", "words").mapInArrow(_numbered, f"task long, {PLACED}"), "placed")
    common.unstash(tied, digests)
    # A task shares at most its first and its last conversation with others: two rows a task.
    ends = sorted((r["task"], r["low"], r["high"]) for r in rows.groupBy("task").agg(F.min("c").alias("low"), F.max("c").alias("high")).collect())
    shared = {a[2] for a, b in zip(ends, ends[1:], strict=False) if a[2] == b[1]}
    if not shared:
        return rows.drop("task")
    shared = F.broadcast(spark.createDataFrame([(c,) for c in shared], "shared long"))
    pieces = rows.join(shared, F.col("c") == F.col("shared")).groupBy("c", "task").agg(F.max(F.struct("pos", *SUMS)).alias("end")).select("c", "task", "end.*").collect()
    before, at = [], (None, 0, 0, 0)
    for c, task, pos, *sums in sorted(map(tuple, pieces)):
        n, *so_far = at[1:] if at[0] == c else (0, 0, 0)
        before.append((c, task, n, *(s - 2**64 if s >= 2**63 else s for s in so_far)))
        at = (c, n + pos + 1, *((s + q * pow(b, n, 2**64)) % 2**64 for s, q, b in zip(so_far, sums, BASES, strict=True)))
    known = F.broadcast(spark.createDataFrame(before, "piece_c long, piece_task long, before long, q1_before long, q2_before long"))
    joined = rows.join(known, (F.col("c") == F.col("piece_c")) & (F.col("task") == F.col("piece_task")), "left")
    plain = joined.where("before IS NULL").select(*[c.split()[0] for c in PLACED.split(", ")])
    return plain.unionByName(joined.where("before IS NOT NULL").mapInArrow(_moved, PLACED))


def _spliced(batches):
    """Conversations after the exchange of their heads: depth of the end, name of the whole and of its first turn, and what
    is to be taken off and added to a turn's own polynomial."""
    for b in batches:
        head, base_n, n = (b[x].to_numpy() for x in ("head", "base_n", "n"))
        taken = np.minimum(head, base_n)
        length = taken + np.maximum(n - head, 0)
        out = {}
        for i, base in enumerate(BASES, 1):
            own, other = ([np.zeros(b.num_rows, np.uint64), *(_unsigned(b[f"{side}{k}_q{i}"]) for k in range(HEADS + 1))] for side in ("own", "base"))
            off = np.choose(np.minimum(head, n), own[: HEADS + 1])
            onto = np.choose(taken, other[: HEADS + 1])
            shift = _power(base, taken - head)
            end = np.where(n > head, onto + (_unsigned(b[f"end_q{i}"]) - off) * shift, onto)
            after = np.choose(np.minimum(head, HEADS) + 1, own)
            first = np.where(taken > 0, other[1], (after - off) * shift)
            out |= {f"off{i}": off, f"onto{i}": onto, f"f{i}": end, f"g{i}": np.where(length > 0, first, np.uint64(0))}
        yield _batch(SPLICED, c=b["c"].to_numpy(), base=b["base"].to_numpy(), head=head, taken=taken, len=length, **out)


def _named(batches):
    """Turns of the rebuilt conversations with the names of the prefixes that end with them and of their parents."""
    for b in batches:
        own = b["own"].to_numpy(zero_copy_only=False)
        shift = np.where(own, b["taken"].to_numpy() - b["head"].to_numpy(), 0)
        depth = b["pos"].to_numpy() + 1 + shift
        names = {}
        for i, base in enumerate(BASES, 1):
            q = _unsigned(b[f"q{i}"])
            p = np.where(own, _unsigned(b[f"onto{i}"]) + (q - _unsigned(b[f"off{i}"])) * _power(base, shift), q)
            names |= {f"p{i}": p, f"up{i}": p - _unsigned(b[f"t{i}"]) * _power(base, depth - 1)}
        yield _batch(NAMED, rep=b["c"].to_numpy(), depth=depth, len=b["len"].to_numpy(), weight=b["weight"].to_numpy(), t1=_unsigned(b["t1"]), t2=_unsigned(b["t2"]), words=b["words"].to_numpy(), g1=_unsigned(b["g1"]), g2=_unsigned(b["g2"]), ends=b["ends"], **names)


def _tries(pdf: pd.DataFrame) -> pd.DataFrame:
    """All tries of a call: dictionaries from a turn's digest to the number of the child, then an iterative postorder."""
    pdf = pdf.sort_values(["rep", "depth"], ignore_index=True)
    roots: dict = {}
    children, first_row, convs, conv, ends = [], [], [], [], []
    rep, at = None, None
    for i, (r, k1, k2, t1, t2, w, end) in enumerate(zip(*(pdf[x].tolist() for x in ("rep", "k1", "k2", "t1", "t2", "weight", "ends")), strict=True)):
        table, label = (roots, (k1, k2)) if r != rep else (children[at], (t1, t2))
        rep, at = r, table.get(label)
        if at is None:
            at = table[label] = len(children)
            children.append({})
            first_row.append(i)
            convs.append(0)
            conv.append(r)
            ends.append(NOBODY)
        convs[at] += w
        conv[at] = min(conv[at], r)
        if end is not None:
            ends[at] = end
    words = pdf["words"].to_numpy()[first_row]
    saved, leaves, parent = [(n - 1) * int(w) for n, w in zip(convs, words, strict=True)], [0] * len(convs), [None] * len(convs)
    stack = [(node, iter(children[node].values())) for node in roots.values()]
    while stack:
        node, rest = stack[-1]
        child = next(rest, None)
        if child is not None:
            parent[child] = conv[node]
            stack.append((child, iter(children[child].values())))
            continue
        stack.pop()
        leaves[node] = sum(leaves[x] for x in children[node].values()) or 1
        saved[node] += sum(saved[x] for x in children[node].values())
    out = pdf.iloc[first_row][["depth", "p1", "p2", "up1", "up2"]].reset_index(drop=True)
    return out.assign(conv_id=conv, parent_conv_id=pd.array(parent, dtype="Int64"), n_convs=convs, n_children=[len(c) for c in children], n_leaves=leaves, saved_tokens=saved, ends=ends)


def _ends(members: DataFrame, name: list[str]) -> DataFrame:
    """ends: SHA-256 of the members' ids, ascending and joined, of each name. Ids are joined in pieces of 4096 numbers, then streamed."""

    def stream(batches):
        last, digest = None, None
        for b in batches:
            done = []
            for *key, ids in zip(*(b[c].to_pylist() for c in (*name, "ids")), strict=True):
                if key != last:
                    if last is not None:
                        done.append((*last, digest.hexdigest()))
                    last, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip((*name, "ends"), d, strict=True)) for d in done], schema)
        if last is not None:
            yield pa.RecordBatch.from_pylist([dict(zip((*name, "ends"), (*last, digest.hexdigest()), strict=True))], schema)

    schema = pa.schema([*((c, pa.int64()) for c in name), ("ends", pa.string())])
    piece = F.shiftright("c", 12).alias("piece")
    pieces = members.groupBy(*name, piece).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids"))
    return pieces.repartition(*name).sortWithinPartitions(*name, "piece").select(*name, "ids").mapInArrow(stream, ", ".join(f"{c} long" for c in name) + ", ends string")


def _summed(heavy: DataFrame, deepest: int) -> DataFrame:
    """heavy with n_leaves and saved_tokens over whole subtrees: each round adds to every node the sums of those twice as
    far below as in the round before, and doubles how far its pointer reaches up."""
    key, up = ["depth", "p1", "p2"], ["up_depth", "up_p1", "up_p2"]
    rows = common.stash(heavy.select(*key, (F.col("depth") - 1).alias("up_depth"), F.col("up1").alias("up_p1"), F.col("up2").alias("up_p2"), "n_leaves", "saved_tokens"), "sums")
    reach = 1
    while reach < deepest:
        added = rows.where("up_depth > 0").groupBy(*up).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        added = added.select(*[F.col(u).alias(k) for u, k in zip(up, key, strict=True)], "more_leaves", "more_saved")
        above = rows.select(*[F.col(k).alias(u) for k, u in zip(key, up, strict=True)], *[F.col(u).alias(f"next_{u}") for u in up])
        more = rows.join(added, key, "left").join(above, up, "left").select(
            *key, F.coalesce("next_up_depth", F.lit(0)).alias("up_depth"), *[F.col(f"next_{u}").alias(u) for u in up[1:]],
            (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
        )
        more = common.stash(more, "sums")
        common.unstash(rows)
        rows, reach = more, 2 * reach
    return rows.select(*key, "n_leaves", "saved_tokens")


def prefix_trie(turns: DataFrame, base=None, head=None, most: int = MOST, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (long) and ends_sha256 of each node. base, head:
    functions of the id column; a conversation's first head(id) turns (HEADS at most) give way to those of base(id)."""
    spark, c = turns.sparkSession, F.col("c")
    rows = placed(turns, conv_col, turn_col, role_col, text_col)
    own = F.struct("pos", "t1", "t2", "words", *SUMS)
    heads = F.array_sort(F.collect_list(F.when(F.col("pos") <= HEADS, own)))
    convs = rows.groupBy("c").agg(F.count("*").alias("n"), heads.alias("own"), F.max(F.struct("pos", *SUMS)).alias("end"))
    convs = convs.select("c", (base(c) if base else c).cast("long").alias("base"), F.least(head(c) if head else F.lit(0), F.lit(HEADS)).cast("long").alias("head"), "n", "own", "end")
    convs = common.stash(convs, "conversations")
    bases = convs.select(c.alias("b"), F.col("own").alias("their"), F.col("n").alias("base_n"))
    flat = [F.get(side, F.lit(k))[q].alias(f"{to}{k}_{q}") for side, to in (("own", "own"), ("their", "base")) for k in range(HEADS + 1) for q in SUMS]
    joined = convs.join(bases, F.col("base") == F.col("b"), "left")
    spliced = joined.select("c", "base", "head", "n", F.coalesce("base_n", F.lit(0)).cast("long").alias("base_n"), *[F.col(f"end.{q}").alias(f"end_{q}") for q in SUMS], *flat).mapInArrow(_spliced, SPLICED)
    spliced = common.stash(spliced, "spliced")
    name = ["len", "f1", "f2"]
    classes = spliced.groupBy(*name).agg(F.count("*").alias("weight"), F.min(F.struct("c", "base", "head", "taken", *[f"{x}{i}" for i in (1, 2) for x in ("off", "onto", "g")])).alias("r")).select(*name, "weight", "r.*")
    classes = common.stash(classes, "classes")
    several = classes.where("weight > 1").select(*name)
    ends = _ends(spliced.join(several, name, "left_semi"), name)
    alone = F.sha2(c.cast("string").cast("binary"), 256)
    ended = common.stash(classes.join(ends, name, "left").withColumn("ends", F.coalesce("ends", alone)), "ended")

    # The turns of one conversation of each class: its own behind the head, and those that it takes over.
    facts = ended.where("len > 0").select(F.col("c").alias("rep"), "base", "head", "taken", "len", "weight", "ends", *[f"{x}{i}" for i in (1, 2) for x in ("off", "onto", "g")])
    mine = rows.join(facts, F.col("c") == F.col("rep")).where(F.col("pos") >= F.col("head")).drop("c").withColumn("own", F.lit(True))
    given = facts.where("taken > 0").join(bases, F.col("base") == F.col("b")).select("*", F.explode(F.slice("their", 1, F.col("taken").cast("int"))).alias("t"))
    given = given.select(*facts.columns, "t.*", F.lit(False).alias("own"))
    both = mine.unionByName(given.select(*mine.columns)).withColumnRenamed("rep", "c")
    last = F.col("pos") + 1 + F.when(F.col("own"), F.col("taken") - F.col("head")).otherwise(0) == F.col("len")
    named = common.stash(both.withColumn("ends", F.when(last, F.col("ends"))).mapInArrow(_named, NAMED), "named")

    # Prefixes of more than `most` turns, those of first turns before those below.
    wide = common.stash(named.where("depth = 1").groupBy("g1", "g2").agg(F.sum("len").alias("turns")).where(F.col("turns") > most).select("g1", "g2"), "wide")
    key = ["depth", "p1", "p2"]
    below = named.join(wide, ["g1", "g2"], "left_semi")
    heavy = below.groupBy(*key).agg(
        F.sum(F.col("len") - F.col("depth") + 1).alias("turns"), F.max("up1").alias("up1"), F.max("up2").alias("up2"), F.min("rep").alias("conv_id"),
        F.sum("weight").alias("n_convs"), F.max("words").alias("words"), F.coalesce(F.max("ends"), F.lit(NOBODY)).alias("ends"),
    ).where(F.col("turns") > most)
    heavy = common.stash(heavy, "heavy")
    deep = below.join(heavy.select(*key), key, "left_semi").groupBy("rep").agg(F.max("depth").alias("cut"))
    start = below.select("rep", (F.col("depth") - 1).alias("cut"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    start = common.stash(deep.join(start, ["rep", "cut"], "left"), "start")
    parts = named.join(start, "rep", "left").where(F.col("depth") > F.coalesce("cut", F.lit(0)))
    parts = parts.withColumns({"k1": F.coalesce("k1", "g1"), "k2": F.coalesce("k2", "g2")})
    calls = max(1, -(-named.count() // most))
    call = F.pmod(F.xxhash64("k1", "k2"), F.lit(calls)).alias("call")
    light = parts.select(call, "rep", "depth", "k1", "k2", "t1", "t2", "weight", "words", "ends", "p1", "p2", "up1", "up2").groupBy("call").applyInPandas(lambda pdf: _tries(pdf), NODE)
    light = common.stash(light, "light")

    # What hangs directly below each node above the cuts.
    up = [(F.col("depth") - 1).alias("depth"), F.col("up1").alias("p1"), F.col("up2").alias("p2")]
    hung = light.where("parent_conv_id IS NULL").select(*up, F.lit(1).alias("n"), "n_leaves", "saved_tokens")
    hung = hung.unionByName(heavy.select(*up, F.lit(1).alias("n"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")))
    hung = hung.groupBy(*key).agg(F.sum("n").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    none = F.lit(0).cast("long")
    top = heavy.join(hung, key, "left").select(
        *key, "up1", "up2", "conv_id", "n_convs", "ends", F.coalesce("n_children", none).alias("n_children"), F.when(F.col("n_children").isNull(), 1).otherwise(F.col("n_leaves")).alias("n_leaves"),
        (F.coalesce("saved_tokens", none) + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    top = common.stash(top, "top")
    summed = _summed(top, heavy.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0])
    top = common.stash(top.drop("n_leaves", "saved_tokens").join(summed, key), "above")
    whole = classes.agg(F.min("c"), F.sum("weight")).first()
    # The root's conversation is the smallest of all: one number.
    parents = heavy.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("up1"), F.col("p2").alias("up2"), F.col("conv_id").alias("above"))
    root_conv = F.lit(whole[0]).cast("long")
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    nodes = light.where("parent_conv_id IS NULL").drop("parent_conv_id").unionByName(top.select(*[x.split()[0] for x in NODE.split(", ") if "parent" not in x]))
    nodes = nodes.join(parents, ["depth", "up1", "up2"], "left").withColumn("parent_conv_id", F.when(F.col("depth") == 1, root_conv).otherwise(F.col("above")))
    first = nodes.where("depth = 1").agg(F.count("*"), F.coalesce(F.sum("n_leaves"), F.lit(1)), F.coalesce(F.sum("saved_tokens"), none)).first()
    turnless = ended.where("len = 0").agg(F.coalesce(F.max("ends"), F.lit(NOBODY))).first()
    row = [] if whole[0] is None else [(whole[0], 0, None, whole[1], *first, *turnless)]
    root = spark.createDataFrame(row, "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    out = common.stash(light.where("parent_conv_id IS NOT NULL").select(*result).unionByName(nodes.select(*result)).unionByName(root), "nodes")
    common.unstash(convs, spliced, classes, ended, named, wide, heavy, start, light, top)
    return out


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie(turns, base=lambda c: c - c % 20, head=lambda c: F.crc32(c.cast("string").cast("binary")) % 4)


_CRC_BYTE = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
_CRC = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda z: ascii(z)::BIGINT)), lambda a, b: {_CRC_BYTE}), 4294967295)"
OP11_SQL = rf"""
WITH turns AS (
  SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT c, own, {_CRC} % 4 AS h FROM turns),
rebuilt AS MATERIALIZED (
  SELECT t.c, list_concat(CASE WHEN b.c IS NULL THEN list_slice(t.own, 1, 0) ELSE list_slice(b.own, 1, t.h) END, list_slice(t.own, t.h + 1, len(t.own))) AS seq
  FROM heads t LEFT JOIN turns b ON b.c = t.c - t.c % 20),
members AS MATERIALIZED (SELECT c, d, list_slice(seq, 1, d) AS p, len(seq) AS n FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)),
nodes AS MATERIALIZED (
  SELECT p, row_number() OVER () AS id, d, min(c) AS conv_id, count(*) AS n_convs,
         CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].x, '[^ 	-
]+')) END AS words,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM members GROUP BY p, d),
spots AS MATERIALIZED (SELECT m.c, m.d, n.id FROM members m JOIN nodes n ON m.p = n.p AND m.d = n.d),
parents AS (SELECT a.id, any_value(b.id) AS parent FROM spots a JOIN spots b ON a.c = b.c AND b.d = a.d - 1 GROUP BY a.id),
children AS (SELECT parent, count(*) AS n FROM parents GROUP BY parent),
below AS (SELECT DISTINCT a.id AS top, b.id FROM spots a JOIN spots b ON a.c = b.c AND b.d >= a.d),
sums AS (
  SELECT top, sum((u.n_convs - 1) * u.words) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM below JOIN nodes u ON below.id = u.id LEFT JOIN children k ON k.parent = u.id GROUP BY top)
SELECT v.conv_id, v.d::BIGINT AS depth, o.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, v.ends_sha256
FROM nodes v JOIN sums s ON s.top = v.id LEFT JOIN parents q ON q.id = v.id LEFT JOIN nodes o ON o.id = q.parent LEFT JOIN children k ON k.parent = v.id
"""
