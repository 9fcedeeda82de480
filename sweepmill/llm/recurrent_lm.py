"""Language-model scoring with a gated recurrent network and a class-factored softmax.

Every word of the training documents is counted, in one shuffle of (hash, count). The `words` commonest words, and the
end of a document, are symbols of their own, in output classes of `CLASS` words by frequency; all further words
fall into `REST` classes by their first two letters. The network predicts the next class, and inside a class of common
words the word; inside a class of other words the smoothed counts do, so the model covers the same words as the smoothed
unigram model that serves as base, which is also where its biases start.

Training is truncated backpropagation in numpy, spread over tasks: every training
document is learnt from in one of `rounds` rounds, by hash of the id, whose documents are dealt over tasks of about
`per_task` tokens; each task starts from the same weights, and their results are averaged by tokens (one number a weight
comes back). Scoring
keeps the state of the network from window to window through a whole document, many documents side by side.

Counts of the commonest `table` words (a documented bound) go to all tasks; the other words of a document, distinct ones
with their number, are joined with the counts by a shuffle, so no vocabulary of any size is held in one place.

Defined results: a null text is empty and scores its end alone; a null id is held out; with nothing to learn from every token
has probability 1 under the base, and under the model that of its class, untrained; rows that repeat an id are scored each;
words are told apart by 64 bits of hash; further columns are not carried.
"""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS, CLASS, REST, HIDDEN = 1024, 32, 32, 24
TABLE, ROUNDS, PER_TASK = 1 << 17, 4, 1_000_000
#: Documents side by side and steps of a window, in training and in scoring. Training goes through longer documents in pieces.
LANES, STEPS, WIDE, LONG, PIECE = 256, 16, 128, 64, 1024
RATE, SEED = 0.08, 5
#: Exponents up to this need no shift in single precision; states whose logits are worked out at once, which stay in a core's cache,
#: and weights whose changes are one row.
SAFE, BLOCK = 60, 1024
#: Gradients of symbols that occur this often in a window are summed symbol by symbol.
MANY = 16
END = np.uint64(0x9E6D62D06F6A9A9B)
COMMON_CLASSES = WORDS // CLASS
SHAPES = {
    "x": (WORDS + REST, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, COMMON_CLASSES + REST), "bc": (COMMON_CLASSES + REST,),
    "wo": (COMMON_CLASSES, HIDDEN, CLASS), "bo": (COMMON_CLASSES, CLASS),
}


#: Class of a word by its first two bytes, a space if it has one.
_KIND = (common.mix64(common._LOWER.astype(np.uint64)[:, None] * np.uint64(256) + np.where(common._SPACE, 0, common._LOWER).astype(np.uint64)) % np.uint64(REST)).astype(np.int64).reshape(-1)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class by first letters of each token, an end after each text, and the offsets of the texts' tokens."""
    raw, begin = common._raw(texts)
    words, where, _ = common._words(raw, begin)
    at = np.searchsorted(where, begin)
    follow = np.where(where + 1 < begin[-1], raw[np.minimum(where + 1, max(len(raw) - 1, 0))], np.uint8(32)) if len(words) else np.zeros(0, np.uint8)
    letters = raw[where].astype(np.int64) * 256 + follow
    n = len(begin) - 1
    ends = at[1:] + np.arange(n)
    hashes, kind = np.full(len(words) + n, END), np.zeros(len(words) + n, dtype=np.int64)
    inner = np.ones(len(words) + n, dtype=bool)
    inner[ends] = False
    hashes[inner], kind[inner] = words, _KIND[letters]
    return hashes, kind, np.concatenate(([0], ends + 1))


class Vocabulary:
    """The commonest words by hash: counts, and the symbol of those that are common. Mass of the rest by class."""

    def __init__(self, hashes, counts, kinds, total: int, distinct: int, mass: np.ndarray, size: np.ndarray):
        self.total, self.distinct = total, distinct
        held = dict(zip(hashes.tolist(), counts.tolist(), strict=True))
        own = [int(END), *[h for h in hashes.tolist() if h != int(END)][: WORDS - 1]]
        symbol = {h: i for i, h in enumerate(own)}
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        # Behind the table stands what no word is; a place to begin from is kept for each beginning of a hash.
        self.sorted, self.numbers = np.append(self.hashes, np.uint64(2**64 - 1)), np.append(self.counts, -1)
        self.symbols = np.array([*[symbol.get(h, -1) for h in self.hashes.tolist()], -1], dtype=np.int64)
        self.shift = np.uint64(64 - max(1, len(self.sorted).bit_length()))
        self.first = np.searchsorted(self.hashes, np.arange(2 ** (64 - int(self.shift)), dtype=np.uint64) << self.shift).astype(np.int32)
        self.own = np.array([held.get(h, 0) for h in own] + [0] * (WORDS - len(own)), dtype=np.int64)
        common_words = np.array([h in symbol and h != int(END) for h in hashes.tolist()], dtype=bool)
        mass, size = mass.astype(np.float64).copy(), size.astype(np.float64).copy()
        np.subtract.at(mass, kinds[common_words], counts[common_words])
        np.subtract.at(size, kinds[common_words], 1)
        self.rest = mass + 0.1 * size + 0.1

    def look_up(self, hashes: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each token, and its count if the table has it, else -1."""
        at = self.first[hashes >> self.shift]
        far = np.flatnonzero(self.sorted[at] < hashes)
        while len(far):
            at[far] += 1
            far = far[self.sorted[at[far]] < hashes[far]]
        found = self.sorted[at] == hashes
        symbol = np.where(found, self.symbols[at], -1)
        symbol[hashes == END] = 0
        return np.where(symbol >= 0, symbol, WORDS + kind), np.where(found, self.numbers[at], -1)


def untrained(words: Vocabulary) -> dict[str, np.ndarray]:
    """Weights of a network that says what smoothed counts say."""
    rng = np.random.default_rng(SEED)
    out = {name: np.zeros(shape, dtype=np.float32) for name, shape in SHAPES.items()}
    out["x"] = rng.normal(0, 0.3, SHAPES["x"]).astype(np.float32)
    out["u"] = rng.normal(0, HIDDEN**-0.5, SHAPES["u"]).astype(np.float32)
    mass = (words.own + 0.1).reshape(COMMON_CLASSES, CLASS)
    out["bo"] = np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32)
    whole = np.concatenate((mass.sum(axis=1), words.rest))
    out["bc"] = np.log(whole / whole.sum()).astype(np.float32)
    return out


def _lanes(begin: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each token goes: its cell in a table of steps and lanes, row by row; and how long each lane is, longest first.
    Documents follow one another in a lane; the longest are dealt first, each to the lane that is free first."""
    length = np.diff(begin)
    free, start, lane = [(0, k) for k in range(min(wide, max(len(length), 1)))], np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for d in np.argsort(-length, kind="stable").tolist():
        used, k = free[0]
        start[d], lane[d] = used, k
        heapq.heapreplace(free, (used + int(length[d]), k))
    total = np.zeros(len(free), np.int64)
    total[[k for _, k in free]] = [used for used, _ in free]
    order = np.argsort(-total, kind="stable")
    rank = np.empty(len(free), np.int64)
    rank[order] = np.arange(len(free))
    step = np.arange(begin[-1]) - np.repeat(begin[:-1] - start, length)
    return step * len(free) + np.repeat(rank[lane], length), total[order]


def _table(symbols: np.ndarray, begin: np.ndarray, starts: np.ndarray, wide: int):
    """Steps x lanes of what goes before each token, where the state is fresh (at `starts`), and the token (-1: none); the
    cells of the tokens, and the lanes' lengths. The end stands before a document (from `begin`)."""
    cell, total = _lanes(starts, wide)
    before, fresh, target = np.zeros(total[0] * len(total), dtype=np.int64), np.zeros(total[0] * len(total), dtype=bool), np.full(total[0] * len(total), -1, dtype=np.int64)
    target[cell], before[cell[1:]], fresh[cell[starts[:-1]]] = symbols, symbols[:-1], True
    before[cell[begin[:-1]]] = 0
    return *(x.reshape(-1, len(total)) for x in (before, fresh, target)), cell, total


def _by_gate(w: dict) -> tuple[np.ndarray, np.ndarray]:
    """x and u with the gate (keep, reset, new) as first axis, times what stands in the exponent of a sigmoid or tanh."""
    scale = np.array([-1, -1, -2], dtype=w["u"].dtype)[:, None, None]
    return tuple(np.ascontiguousarray(w[m].reshape(-1, 3, HIDDEN).swapaxes(0, 1)) * scale for m in ("x", "u"))


def _forward(w: dict, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray, kept: np.ndarray | None = None) -> np.ndarray:
    """States after each step. inputs, fresh: steps x lanes; fresh: a document begins, from the zero state.
    kept (5, steps, lanes, HIDDEN): gets the two gates, and how much of a change of the state reaches the gate that keeps,
    the new state and, of a change of that, the gate that resets."""
    x, u = _by_gate(w)
    g, a = np.empty((2, 3, inputs.shape[1], HIDDEN), dtype=u.dtype)
    zr, z, r, new, a_zr, a_new = g[:2], g[0], g[1], g[2], a[:2], a[2]
    out, any_fresh = np.empty((*inputs.shape, HIDDEN), dtype=u.dtype), fresh.any(axis=1).tolist()
    with np.errstate(over="ignore"):  # a gate is then at its end
        for t in range(len(inputs)):
            if any_fresh[t]:
                h = np.where(fresh[t][:, None], u.dtype.type(0), h)
            x.take(inputs[t], axis=1, out=g, mode="clip")
            np.matmul(h, u, out=a)
            zr += a_zr
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            new += r * a_new
            np.exp(new, out=new)
            new += 1
            np.divide(2, new, out=new)
            new -= 1
            h = np.subtract(h, new, out=out[t])
            h *= z
            if kept is not None:
                kept[:2, t] = zr
                rest = 1 - z
                np.multiply(h, rest, out=kept[2, t])  # (before - new) z (1 - z)
                square = new * new
                np.subtract(1, square, out=square)
                np.multiply(square, rest, out=kept[3, t])
                a_new *= -0.5  # what stands in the exponent is times -2
                np.subtract(1, r, out=rest)
                rest *= r
                np.multiply(rest, a_new, out=kept[4, t])
            h += new
    return out


def _bounded(logits: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logits whose exponentials neither overflow nor vanish: less the largest of the row, unless states (-1 to 1) times these
    weights cannot be large."""
    if not np.abs(weights).sum(axis=-2).max() <= SAFE:
        logits -= logits.max(axis=1, keepdims=True)
    return logits


def _places(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the entries `at` of each row, row after row."""
    return np.arange(0, table.size, table.shape[1]) + at


def _shares(logits: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Softmax of each row, in place."""
    np.exp(_bounded(logits, weights), out=logits)
    logits *= (1 / (logits @ np.ones(logits.shape[1], dtype=logits.dtype)))[:, None]
    return logits


def _log_share(logits: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The entries `at` of the log softmax of each row."""
    own = _bounded(logits, weights).reshape(-1)[_places(logits, at)]
    return own - np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], dtype=logits.dtype))


def _with_one(states: np.ndarray, real: np.ndarray) -> np.ndarray:
    """The real ones of all states, and a one that biases are multiplied with."""
    out = np.ones((len(real), HIDDEN + 1), dtype=states.dtype)
    out[:, :HIDDEN] = states.reshape(-1, HIDDEN)[real]
    return out


def _biased(w: dict) -> tuple[np.ndarray, np.ndarray]:
    """Output weights of the classes and inside each class, with the biases as last row."""
    return np.concatenate((w["wc"], w["bc"][None])), np.concatenate((w["wo"], w["bo"][:, None]), axis=1)


def _by_class(targets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]], int]:
    """Places of the targets that are there (not -1), common words by class before others, the slice of each class of common
    words that occurs, and the number of common words."""
    cls = np.minimum(targets // CLASS, COMMON_CLASSES) + 1
    bounds = np.cumsum(np.bincount(cls, minlength=COMMON_CLASSES + 1)[: COMMON_CLASSES + 1]).tolist()
    order = np.argsort(cls.astype(np.int16), kind="stable")[bounds[0] :]  # a radix sort, as numbers are short
    return order, [(c, slice(a - bounds[0], b - bounds[0])) for c, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a], bounds[-1] - bounds[0]


def _inside(flat: np.ndarray, wo: np.ndarray, slices: list[tuple[int, slice]]) -> np.ndarray:
    """Logits of the words of a state's class; states by class."""
    out = np.empty((len(flat), CLASS), dtype=flat.dtype)
    for c, some in slices:
        np.matmul(flat[some], wo[c], out=out[some])
    return out


def _classes(targets: np.ndarray) -> np.ndarray:
    return np.where(targets < WORDS, targets // CLASS, COMMON_CLASSES - WORDS + targets)


def log_likelihood(w: dict, symbols: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Natural log probability of each symbol (of the class alone for other words), given all before it in its document."""
    if not len(symbols):
        return np.zeros(0)
    before, fresh, target, cell, total = _table(symbols, begin, begin, WIDE)
    out, h = np.zeros(target.shape), np.zeros((len(total), HIDDEN), dtype=np.float32)
    wc, wo = _biased(w)
    for t in range(0, len(target), LONG):
        # Lanes that are at their end drop out, so one long document does not hold up the width of all.
        some = slice(t, t + LONG), slice(0, int(np.searchsorted(-total, -t)))
        states = _forward(w, before[some], fresh[some], h[some[1]])
        h = states[-1]
        flat_target = target[some].reshape(-1)
        real, slices, own = _by_class(flat_target)
        asked, flat = flat_target[real], _with_one(states, real)
        got, classes = np.empty(len(real)), _classes(asked)
        for k in range(0, len(real), BLOCK):
            part = slice(k, k + BLOCK)
            got[part] = _log_share(flat[part] @ wc, wc, classes[part])
        got[:own] += _log_share(_inside(flat[:own], wo, slices), wo, asked[:own] % CLASS)
        values = np.zeros(len(flat_target))
        values[real] = got
        out[some] = values.reshape(target[some].shape)
    return out.reshape(-1)[cell]


def _by_symbol(symbols: np.ndarray, d_gates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur, the commonest first, and the sums of their gradients (new state, two gates), in the order of the weights."""
    counts = np.bincount(symbols, minlength=WORDS + REST)
    rank = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    place = np.empty(len(counts), dtype=np.int16)
    place[rank] = np.arange(len(rank))
    d_gates, counts = d_gates.take(np.argsort(place[symbols], kind="stable"), axis=1), counts[rank]
    ends, often = np.cumsum(counts), int(np.count_nonzero(counts >= MANY))
    out, ones = np.zeros((3, len(rank), HIDDEN), dtype=d_gates.dtype), np.ones(len(symbols), dtype=d_gates.dtype)
    for k, (n, b) in enumerate(zip(counts[:often].tolist(), ends[:often].tolist(), strict=True)):
        np.matmul(ones[:n], d_gates[:, b - n : b], out=out[:, k])
    # The first of each other symbol, then the second, as long as there are such.
    first, left = (ends - counts)[often:], counts[often:]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.count_nonzero(left > k))
        out[:, often : often + n] += d_gates.take(first[:n] + k, axis=1)
    new, z, r = out
    return rank, np.concatenate((z, r, new), axis=1)


def _gradients(w: dict, inputs: np.ndarray, fresh: np.ndarray, targets: np.ndarray, h: np.ndarray):
    """One window: its gradients (as places and values), the state at its end."""
    n, kept = HIDDEN, np.empty((5, *inputs.shape, HIDDEN), dtype=w["u"].dtype)
    states = _forward(w, inputs, fresh, h, kept)
    flat_targets = targets.reshape(-1)
    real, slices, own = _by_class(flat_targets)
    asked, flat = flat_targets[real], _with_one(states, real)
    wc, wo = _biased(w)
    classes, d_wc, d_flat = _classes(asked), np.zeros_like(wc), np.empty((len(real), n), dtype=flat.dtype)
    for k in range(0, len(real), BLOCK):
        part = slice(k, k + BLOCK)
        d = _shares(flat[part] @ wc, wc)
        d.reshape(-1)[_places(d, classes[part])] -= 1
        d_wc[:n] += (d.T @ flat[part, :n]).T
        d_wc[n] += np.ones(len(d), dtype=d.dtype) @ d
        np.matmul(d, w["wc"].T, out=d_flat[part])
    d_wo, d_own = np.zeros_like(wo), np.empty((own, n), dtype=flat.dtype)
    d = _shares(_inside(flat[:own], wo, slices), wo)
    d.reshape(-1)[_places(d, asked[:own] % CLASS)] -= 1
    for c, some in slices:
        np.matmul(flat[some].T, d[some], out=d_wo[c])
        np.matmul(d[some], w["wo"][c].T, out=d_own[some])
    d_flat[:own] += d_own
    grads = [("wc", slice(None), d_wc[:n]), ("bc", slice(None), d_wc[n]), ("wo", slice(None), d_wo[:, :n]), ("bo", slice(None), d_wo[:, n])]
    d_states = np.zeros((inputs.size, n), dtype=states.dtype)
    d_states[real] = d_flat
    d_states = d_states.reshape(states.shape)

    z, r, to_z, to_new, to_r = kept
    before = np.concatenate((h[None], states[:-1]))
    before[fresh] = 0
    u = np.ascontiguousarray(w["u"].reshape(n, 3, n).transpose(1, 2, 0))
    # Of the new state, the two gates, and the new state as it reaches u.
    d_gates, back, through = np.empty((4, *states.shape), dtype=states.dtype), np.zeros_like(h), np.empty((3, *h.shape), dtype=states.dtype)
    for t in range(len(inputs) - 1, -1, -1):
        d, g = d_states[t], d_gates[:, t]
        d += back
        np.multiply(d, to_new[t], out=g[0])
        np.multiply(d, to_z[t], out=g[1])
        np.multiply(g[0], to_r[t], out=g[2])
        np.multiply(g[0], r[t], out=g[3])
        np.matmul(g[1:], u, out=through)
        np.multiply(d, z[t], out=back)
        for x in through:
            back += x
        back[fresh[t]] = 0
    d_gates = d_gates.reshape(4, -1, n)
    d_u = d_gates[1:].swapaxes(1, 2) @ before.reshape(-1, n)
    grads.append(("u", slice(None), d_u.transpose(2, 0, 1).reshape(n, 3 * n)))
    grads.append(("x", *_by_symbol(inputs.reshape(-1), d_gates[:3])))
    return grads, states[-1]


def learn(w: dict, symbols: np.ndarray, begin: np.ndarray, squares: dict) -> None:
    """Steps of Adagrad through documents side by side, a window at a time; changes w and squares."""
    if not len(symbols):
        return
    starts = np.unique(np.concatenate([begin, *(np.arange(a, b, PIECE) for a, b in zip(begin[:-1], begin[1:], strict=True))]))
    before, fresh, target, _, total = _table(symbols, begin, starts, LANES)
    h = np.zeros((len(total), HIDDEN), dtype=np.float32)
    for t in range(0, len(target), STEPS):
        wide = int(np.searchsorted(-total, -t))
        some = slice(t, t + STEPS), slice(0, wide)
        grads, h = _gradients(w, before[some], fresh[some], target[some], h[:wide])
        for name, at, g in grads:
            g = g / np.float32(wide)
            sums = squares[name][at] + g * g
            squares[name][at] = sums
            sums += np.float32(1e-6)
            g *= np.float32(RATE)
            g /= np.sqrt(sums, out=sums)
            w[name][at] -= g


def _flat(w: dict) -> np.ndarray:
    return np.concatenate([w[name].reshape(-1) for name in SHAPES])


def _shaped(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        out[name] = flat[at : at + int(np.prod(shape))].astype(np.float32).reshape(shape)
        at += int(np.prod(shape))
    return out


def _added(table: pa.Table) -> pa.Table:
    """The sum of the changes of one block of weights, from all tasks."""
    change = table["change"].combine_chunks().flatten().to_numpy().reshape(len(table), -1).sum(axis=0)
    return pa.table({"block": table["block"][:1], "change": pa.array([change], pa.list_(pa.int64()))})


def is_training(doc_id, fold: int = 10):
    """Whether a document is learnt from: crc32 of the id as text is not 0 modulo fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % fold != 0, F.lit(False))


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """hash, kind and count of every token of all texts."""

    def count(batches):
        for batch in batches:
            for part in common.text_chunks(batch.column(0), 1 << 22):
                hashes, kind, _ = tokens(batch.column(0).slice(part.start, part.stop - part.start))
                some, first, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), pa.array(kind[first]), pa.array(n)], names=["hash", "kind", "n"])

    return docs.select(text_col).mapInArrow(count, "hash long, kind long, n long").groupBy("hash").agg(F.max("kind").alias("kind"), F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, table: int = TABLE) -> Vocabulary:
    top = counts.orderBy(F.desc("n"), "hash").limit(table).toArrow()
    sums = counts.where(F.col("hash") != int(END.view(np.int64))).groupBy("kind").agg(F.sum("n"), F.count("*")).collect()
    mass, size = np.zeros(REST), np.zeros(REST)
    for kind, n, words in sums:
        mass[kind], size[kind] = n, words
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hashes, kinds, n = (top[c].to_numpy() for c in ("hash", "kind", "n"))
    return Vocabulary(hashes.view(np.uint64) if len(hashes) else np.zeros(0, np.uint64), n.astype(np.int64), kinds.astype(np.int64), total, distinct, mass, size)


def fit(docs: DataFrame, words: Vocabulary, rounds: int = ROUNDS, per_task: int = PER_TASK, id_col: str = "doc_id", text_col: str = "text") -> dict[str, np.ndarray]:
    """Weights learnt from all documents given, each of them in one round."""
    spark, w = docs.sparkSession, untrained(words)
    held = spark.sparkContext.broadcast(words)
    tasks = max(1, -(-words.total // (rounds * per_task)))
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit("learn"))

    def work(batches, held, start):
        w, squares, seen = _shaped(start.value), _shaped(np.zeros(len(start.value))), 0
        for batch in batches:
            for part in common.text_chunks(batch.column(0), 1 << 21):
                hashes, kind, begin = tokens(batch.column(0).slice(part.start, part.stop - part.start))
                learn(w, held.value.look_up(hashes, kind)[0], begin, squares)
                seen += len(hashes)
        # Whole numbers add up alike in any order.
        change = np.rint((_flat(w).astype(np.float64) - start.value) * seen * 2.0**16).astype(np.int64)
        ends = range(BLOCK, len(change) + BLOCK, BLOCK)
        blocks = [np.array([seen]), *(change[end - BLOCK : end] for end in ends)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks))), pa.array(blocks, pa.list_(pa.int64()))], names=["block", "change"])

    for r in range(rounds):
        start = spark.sparkContext.broadcast(_flat(w).astype(np.float64))
        some = docs.where(F.pmod(order, F.lit(rounds)) == r).select(F.col(text_col).alias("text"), order.alias("order"))
        dealt = some.repartition(tasks, "order").sortWithinPartitions("order", "text").select("text")
        with common.settings(spark, common.STASHING):
            # As many numbers come back as the model has weights.
            sums = dealt.mapInArrow(partial(work, held=held, start=start), "block long, change array<long>").groupBy("block").applyInArrow(_added, "block long, change array<long>").toArrow()
        flat = start.value
        if len(sums):
            numbers = sums.sort_by("block")["change"].combine_chunks().flatten().to_numpy()
            flat = flat + numbers[1:] / (max(1, int(numbers[0])) * 2.0**16)
        w = _shaped(flat)
        start.destroy()
    return w


def score_documents(docs: DataFrame, fold: int = 10, rounds: int = ROUNDS, per_task: int = PER_TASK, table: int = TABLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens (long), base_score and score (double, log10) of each document."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    training = docs.where(is_training(F.col(id_col), fold))
    counts = common.stash(word_counts(training, text_col), "counts")
    words = vocabulary(counts, table)
    w = fit(training, words, rounds, per_task, id_col, text_col)
    held = spark.sparkContext.broadcast((words, w))

    def score(batches):
        for batch in batches:
            words, w = held.value
            for part in common.text_chunks(batch.column(1), 1 << 22):
                n = part.stop - part.start
                hashes, kind, begin = tokens(batch.column(1).slice(part.start, n))
                symbol, count = words.look_up(hashes, kind)
                doc = np.repeat(np.arange(n), np.diff(begin))
                known, rest = count >= 0, symbol >= WORDS
                base = np.where(known, np.log10(np.maximum(count, 0) + 0.1), 0)
                own = log_likelihood(w, symbol, begin) / np.log(10) + np.where(rest, base - np.log10(words.rest[np.where(rest, kind, 0)]), 0)
                far = np.flatnonzero(~known)
                order = far[np.lexsort((hashes[far], doc[far]))]
                lead = np.flatnonzero(np.concatenate(([True], (doc[order][1:] != doc[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])))) if len(order) else np.zeros(0, np.int64)
                times = np.diff(np.concatenate((lead, [len(order)])))
                bounds = pa.array(np.searchsorted(doc[order][lead], np.arange(n + 1)).astype(np.int32))
                sums = [np.bincount(doc, x, n) for x in (known, base, own)]
                columns = [
                    batch.column(0).slice(part.start, n), pa.array(np.diff(begin)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]),
                    pa.ListArray.from_arrays(bounds, pa.array(hashes[order][lead].view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(times)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "known", "base", "own", "far", "times"])

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(score, f"id {kind}, n_tokens long, known long, base double, own double, far array<long>, times array<long>")
    scored = common.stash(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # Distinct words of a document that the table lacks meet the counts of all words.
    far = scored.select("row", F.explode(F.arrays_zip("far", "times")).alias("w")).select("row", F.col("w.far").alias("hash"), F.col("w.times").alias("times"))
    far = far.join(counts.select("hash", "n"), "hash", "left")
    far = far.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("far_known"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("far_base"))
    norm = float(np.log10(words.total + 0.1 * (words.distinct + 1)))
    more = F.coalesce("far_base", F.lit(0.0))
    out = scored.drop("far", "times").join(far, "row", "left").select(
        F.col("id").alias(id_col), (~is_training(F.col("id"), fold)).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"), (F.col("base") + more - F.col("n_tokens") * norm).alias("base_score"), (F.col("own") + more).alias("score"),
    )
    out = common.stash(out, "scores")
    common.unstash(counts, scored)
    return out


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
