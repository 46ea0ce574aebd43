"""Language-model scores of whole documents.

A gated recurrent network in numpy with a class-factored softmax. The ``TOP``
most frequent words (the end of a document is one of them) are dealt by
frequency into classes of ``MEMBERS``; a word's probability is that of its
class times that of the word among the class's members, both given the state.
All other words fall into classes by their shape (last two bytes and what
punctuation follows); the network predicts the class, and the word's share of
it is its smoothed share of the class's training tokens, one unseen word
included. The probabilities of all words, with one unseen word in each shape
class, sum to 1.

1. All training tokens are counted (partial counts per task, then a shuffle by
   word). What the corpus gives grows with it: N, V, the counts, the classes.
2. Every text is read once more and its words' ids are written. The counts of the
   most frequent words, up to ``BROADCAST_WORDS``, go along; the others' (a few
   percent of the tokens) are joined by word.
3. The network learns by truncated backpropagation over windows of ``STEPS``
   tokens from all training documents. They are dealt into a part for each of
   ``ROUNDS`` rounds and into shares of some ``SHARE_DOCS``; the shares of a
   part are learnt from side by side and the weights averaged after the round,
   so all rounds are one pass over everything. A corpus that would leave a
   part fewer than ``LEAST_DOCS`` has fewer parts, read more than once.
4. Every document is scored by its ids: ``SCORE_DOCS`` documents at a time go
   through the network in step, each from its first token to its end.

Null, empty and odd rows: a null or empty text has the end token only; a null
doc_id counts as the empty string in the folds; repeated rows are scored once
each and counted once each. Without training documents the score is the base
score. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import heapq
import pickle
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import byte_slices, crc_mod, keep_freed, utf8_buffer
from tidepool.llm.passages import stage_table

END = "\n"  # no word holds white space
TOP = 2048
MEMBERS = 32
SUFFIXES = 32
SHAPES = 4 * SUFFIXES
HIDDEN = 32
STEPS = 32
STREAMS = 128
LEAST_DOCS = 2_000
SHARE_DOCS = 400
ROUNDS = 5
RATE = 0.01
BROADCAST_WORDS = 200_000
COUNT_FLUSH = 400_000
TOKEN_BYTES = 12 << 20
SCORE_BYTES = 3 << 20
SCORE_DOCS = 256
SCORE_TOKENS = 4_096
BLOCK = 512  # rows whose logits are held at once
PIECE = 128  # rows of a product of matrices: so small, they are multiplied without packing
ADAM_BLOCK = 16_384
REACH = 80.0  # exp of it is within a float32
OFTEN = 16

_TAIL = re.compile(rb"[!-/:-@\[-`{-~]*$")


def shape_class(word: bytes) -> int:
    """What punctuation ends the word (none, a comma, a full stop, other) and
    a bucket of the two bytes before it."""
    tail = _TAIL.search(word)[0]
    kind = {b"": 0, b",": 1, b".": 2}.get(tail, 3)
    core = word[: len(word) - len(tail)]
    return kind * SUFFIXES + zlib.crc32(core[-2:]) % SUFFIXES


_MARK = np.array([bool(_TAIL.search(bytes([x]))[0]) for x in range(256)])
_ONE = np.array([zlib.crc32(bytes([x])) % SUFFIXES for x in range(256)])
_PAIR = np.array([[zlib.crc32(bytes([x, y])) % SUFFIXES for y in range(256)] for x in range(256)])


def shape_classes(words: pa.Array) -> np.ndarray:
    """``shape_class`` of all ``words``."""
    raw, offsets = utf8_buffer(words)
    if not len(raw):
        return np.full(len(words), shape_class(b""))
    start, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    core = np.maximum.accumulate(np.where(_MARK[raw], 0, np.arange(1, len(raw) + 1)))  # where the last byte that is no mark ends
    core = np.where(end > start, np.maximum(core[np.maximum(end, 1) - 1], start), start)
    first, last = raw[np.maximum(core, 2) - 2], raw[np.maximum(core, 1) - 1]
    bucket = np.where(core - start > 1, _PAIR[first, last], np.where(core > start, _ONE[last], shape_class(b"")))
    single, mark = end - core == 1, raw[np.maximum(end, 1) - 1]
    kind = np.where(end == core, 0, np.where(single & (mark == ord(",")), 1, np.where(single & (mark == ord(".")), 2, 3)))
    return kind * SUFFIXES + bucket


# -- counts ----------------------------------------------------------------


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all ``texts``, A-Z lower-cased, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    words, sizes = pc.list_flatten(split), pc.list_value_length(split).to_numpy()
    blank = pc.equal(pc.binary_length(words), 0)  # before and after white space at a text's ends
    if pc.any(blank).as_py():
        row = np.repeat(np.arange(len(sizes)), sizes)
        sizes = np.bincount(row[~blank.to_numpy(zero_copy_only=False)], minlength=len(sizes))
        words = words.filter(pc.invert(blank))
    return words, sizes.astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over the whole texts of ``docs`` (text); each row ends in END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out() -> list[pa.RecordBatch]:
            counted = pa.concat_tables(held)
            if len(held) > 1:
                counted = counted.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
            held.clear()
            return counted.to_batches()

        for whole in batches:
            for batch in byte_slices(whole, "text", TOKEN_BYTES):
                found = words_of(batch.column("text"))[0].value_counts()
                words = pa.chunked_array([found.field("values"), pa.array([END])])
                held.append(pa.table({"word": words, "n": pa.chunked_array([found.field("counts"), pa.array([len(batch)], pa.int64())])}))
                if sum(map(len, held)) > COUNT_FLUSH:
                    yield from out()
        if held:
            yield from out()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame) -> tuple[list[str], list[tuple[str, int]]]:
    """The TOP most frequent words, and (word, n) of them and of all others whose
    counts go along: those of the largest counts, as many whole counts as fit
    into BROADCAST_WORDS. (A limit of so many rows would bring as many words of
    every partition to the driver.)"""
    words = dict(counts.groupBy("n").agg(F.count(F.lit(1))).collect())
    largest = sorted(words, reverse=True)
    reached = list(accumulate(words[n] for n in largest))
    some = counts.where(F.col("n") >= next((n for n, r in zip(largest, reached) if r >= TOP), 0))
    known = [tuple(r) for r in some.orderBy(F.desc("n"), "word").limit(TOP).collect()]
    top = [w for w, _ in known]
    fitting = sum(r <= BROADCAST_WORDS for r in reached)
    if fitting and reached[fitting - 1] > len(top):
        held = set(top)
        rest = [tuple(r) for r in counts.where(F.col("n") >= largest[fitting - 1]).collect()]
        known += sorted((r for r in rest if r[0] not in held), key=lambda r: (-r[1], r[0]))
    return top, known


def shape_totals(counts: DataFrame, top: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct words of each shape class."""
    frequent = pa.array(top, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, kinds = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
        for batch in batches:
            rare = batch.filter(pc.invert(pc.is_in(batch.column("word"), value_set=frequent)))
            shape = shape_classes(rare.column("word"))
            np.add.at(mass, shape, rare.column("n").to_numpy())
            kinds += np.bincount(shape, minlength=SHAPES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHAPES)), pa.array(mass), pa.array(kinds)], ["shape", "mass", "kinds"])

    rows = counts.mapInArrow(run, "shape long, mass long, kinds long").groupBy("shape").agg(F.sum("mass"), F.sum("kinds")).collect()
    mass, kinds = np.zeros(SHAPES), np.zeros(SHAPES)
    for shape, m, k in rows:
        mass[shape], kinds[shape] = m, k
    return mass, kinds


# -- the network -----------------------------------------------------------


def new_network(top_counts: np.ndarray, mass: np.ndarray, kinds: np.ndarray, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """Weights that start at the unigram model: biases are log frequencies. Those
    of the recurrence are in three parts, of the two gates and the candidate."""
    rng = np.random.default_rng(7)
    classes = -(-len(top_counts) // MEMBERS)
    padded = np.zeros(classes * MEMBERS)
    padded[: len(top_counts)] = top_counts + 0.5
    by_class = padded.reshape(classes, MEMBERS)
    with np.errstate(divide="ignore"):
        member_bias = np.maximum(np.log(by_class), -1e4)  # places that no word fills get no mass
    heads = np.r_[by_class.sum(axis=1), mass + 0.5 * (kinds + 1)]

    def small(*size):
        return (rng.normal(size=size) * 0.1).astype(np.float32)

    def three(rows):
        return np.ascontiguousarray(small(rows, 3 * hidden).reshape(rows, 3, hidden).swapaxes(0, 1))

    return {
        "input": three(classes * MEMBERS + SHAPES),
        "gate": np.r_[np.ones(hidden), np.zeros(2 * hidden)].astype(np.float32).reshape(3, hidden),
        "state": three(hidden),
        "class": small(hidden, classes + SHAPES) * 0.1,
        "class_bias": np.log(heads / heads.sum()).astype(np.float32),
        "member": small(classes, hidden, MEMBERS) * 0.1,
        "member_bias": member_bias.astype(np.float32),
    }


def class_of(ids: np.ndarray, classes: int) -> np.ndarray:
    """Frequent words by MEMBERS, then the shape classes."""
    first_shape = classes * MEMBERS
    return np.where(ids < first_shape, ids // MEMBERS, ids - first_shape + classes)


def recurrence(net: dict):
    """What a token adds to the gates and the candidate; the weights of the state of
    the candidate and the gates, the latter with their biases as the last row and
    negated for their exponential; and the candidate's bias."""
    state = np.concatenate([net["state"], net["gate"][:, None]], axis=1)[[2, 0, 1]]
    np.negative(state[1:], out=state[1:])
    state[0, -1] = 0  # that of the candidate is not multiplied by the gate
    return net["input"], state, net["gate"][2]


def advance(weights: tuple, h: np.ndarray, with_ones: np.ndarray, ids: np.ndarray, a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The state after reading ``ids``. Leaves the state's share of the candidate and
    the gates in ``a`` and the candidate in ``v``. ``weights`` are those of
    ``recurrence``; ``with_ones`` is the state ``h`` and a column of ones."""
    given, state, bias = weights
    x, gates = given.take(ids, axis=1), a[1:]
    np.matmul(with_ones, state, out=a)
    gates -= x[:2]
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    np.multiply(a[0], a[2], out=v)
    v += x[2]
    v += bias
    np.tanh(v, out=v)
    h = h - v
    h *= a[1]
    h += v
    return h


def unrolled(weights: tuple, h: np.ndarray, ids: np.ndarray, start: np.ndarray):
    """The states before each of the tokens ``ids`` (steps, rows), with a column of
    ones which the biases are multiplied with, the last state and what
    backpropagation needs: the state's share of the candidate, the gates and the
    candidate. ``start`` (rows, steps) marks where the state is new."""
    steps, rows = ids.shape
    n, dtype = h.shape[1], weights[1].dtype
    new_at = start.any(axis=0)
    parts = np.empty((4, steps, rows, n), dtype)
    states = np.ones((steps, rows, n + 1), dtype)
    for t in range(steps):
        if new_at[t]:
            h = h * ~start[:, t, None]
        states[t, :, :-1] = h
        h = advance(weights, h, states[t], ids[t], parts[:3, t], parts[3, t])
    return states, h, parts


def step(net: dict, h: np.ndarray, ids: np.ndarray):
    """The state after reading ``ids``, and what backpropagation needs."""
    _, last, parts = unrolled(recurrence(net), h, ids[None], np.zeros((len(ids), 1), bool))
    return last, parts[:, 0]


def by_id(ids: np.ndarray, most: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Rows in the order of their ids, and (group, from, to) of each group of
    MEMBERS ids below ``most`` that there are rows of. The first groups are the classes."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")  # so short, they are sorted by digits
    cuts = np.searchsorted(ids[order], np.arange(0, most + MEMBERS, MEMBERS)).tolist()
    return order, [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]


def with_one(h: np.ndarray) -> np.ndarray:
    """The states and a column of ones, which the biases are multiplied with."""
    out = np.ones((len(h), h.shape[1] + 1), h.dtype)
    out[:, :-1] = h
    return out


def pieces(rows: np.ndarray) -> Iterator[np.ndarray]:
    """``rows`` as one array of pieces of PIECE, and what is left as one piece."""
    whole = len(rows) // PIECE * PIECE
    if whole:
        yield rows[:whole].reshape(-1, PIECE, rows.shape[1])
    if whole < len(rows):
        yield rows[None, whole:]


def product(rows: np.ndarray, weights: np.ndarray, out: np.ndarray) -> np.ndarray:
    """``rows @ weights`` in ``out``, piece by piece."""
    for part, to in zip(pieces(rows), pieces(out)):
        np.matmul(part, weights, out=to)
    return out


def within_reach(weights: np.ndarray, bias: np.ndarray, most: float) -> bool:
    """Whether, for states of up to ``most``, no exponential of a logit overflows
    and no row's all vanish, so that they need not be taken relative to the largest."""
    reach = most * np.abs(weights).sum(axis=-2)
    return bool((bias + reach).max() < REACH and (bias - reach).max(axis=-1).min() > -REACH)


def exponentials(logits: np.ndarray, at: np.ndarray, near: bool):
    """exp of ``logits`` in their place, the sum of each row, from before the logits
    at the columns ``at``, and where those are in the raveled array; relative to the
    row's largest unless ``near``."""
    if not near:
        logits -= logits.max(axis=1, keepdims=True)
    cells = np.arange(len(at)) * logits.shape[1] + at
    own = logits.reshape(-1).take(cells)
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], logits.dtype), own, cells


def heads(net: dict, h: np.ndarray | None = None) -> list[tuple[np.ndarray, bool]]:
    """Weights with the biases as the last row, of the classes and of each class's
    members, and whether the logits of the states ``h`` (else: of any that began as
    zeros) are within reach."""
    most = 1.0 if h is None else max(1.0, float(np.abs(h).max(initial=0)))
    biases = [(net[k], net[f"{k}_bias"]) for k in ("class", "member")]
    return [(np.concatenate([w, b[..., None, :]], axis=-2), within_reach(w, b, most)) for w, b in biases]


def log_probabilities(net: dict, h: np.ndarray, ids: np.ndarray, ready: list | None = None) -> np.ndarray:
    """ln P(class | state), and of frequent words + ln P(word | class, state).
    ``ready``: what ``heads`` returns, if it is known; then ``h`` ends in a column
    of ones."""
    classes = len(net["member"])
    head = class_of(ids, classes)
    if ready is None:
        ready, h = heads(net, h), with_one(h)
    (top, top_near), (inner, inner_near) = ready
    out, held = np.empty(len(ids), h.dtype), np.empty((min(BLOCK, len(ids)), top.shape[1]), h.dtype)
    for a in range(0, len(ids), BLOCK):
        logits = product(h[a : a + BLOCK], top, held[: len(ids) - a])
        total, own, _ = exponentials(logits, head[a : a + BLOCK], top_near)
        out[a : a + BLOCK] = own - np.log(total)
    order, spans = by_id(ids, classes * MEMBERS)
    rows = order[: spans[-1][2] if spans else 0]
    sorted_h, logits = h.take(rows, axis=0), np.empty((len(rows), MEMBERS), h.dtype)
    for k, a, b in spans:
        np.matmul(sorted_h[a:b], inner[k], out=logits[a:b])
    total, own, _ = exponentials(logits, ids[rows] % MEMBERS, inner_near)
    out[rows] += own - np.log(total)
    return out


def add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray, order: np.ndarray | None = None) -> None:
    """``np.add.at(to, at, rows)`` for ``to`` of zeros, or that of each part of both:
    the first rows of all places at once, then the second ones, so each sum keeps its
    order. ``order``: the rows to add, sorted (stably) by place, if that is known."""
    if order is None:
        order = np.argsort(at, kind="stable")
    places, rows = at[order], rows.take(order, axis=-2)
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]])[: len(places)])
    sizes = np.diff(first, append=len(places))
    most = np.argsort(-sizes, kind="stable")
    first, sizes = first[most], sizes[most]
    sums = rows.take(first, axis=-2)
    often = int(np.searchsorted(-sizes, -OFTEN))  # so many have more than OFTEN rows: each by itself
    for i, (a, n) in enumerate(zip(first[:often].tolist(), sizes[:often].tolist())):
        sums[..., i, :] = rows[..., a : a + n, :].sum(axis=-2)
    for j in range(1, int(sizes[often]) if often < len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -j))  # the first so many have more than j
        sums[..., often:live, :] += rows.take(first[often:live] + j, axis=-2)
    to[..., places[first], :] = sums


def add_groups(to: np.ndarray, ids: np.ndarray, rows: np.ndarray, order: np.ndarray, spans: list[tuple[int, int, int]]) -> None:
    """``add_rows`` by ``ids`` for the groups of ``by_id``: those of many rows by a
    product with a matrix that has a one where a row is an id's."""
    few = []
    for k, a, b in spans:
        own = order[a:b]
        if len(own) <= 2 * MEMBERS:
            few.append(own)
            continue
        ones = np.zeros((MEMBERS, len(own)), rows.dtype)
        ones[ids[own] - k * MEMBERS, np.arange(len(own))] = 1
        np.matmul(ones, rows.take(own, axis=1), out=to[:, k * MEMBERS : (k + 1) * MEMBERS])
    if few:
        add_rows(to, ids, rows, np.concatenate(few))


class Flat(dict):
    """Arrays by name that are views of one, ``whole``."""

    def __init__(self, like: dict[str, np.ndarray], whole: np.ndarray):
        self.whole = whole
        ends = np.cumsum([v.size for v in like.values()])
        super().__init__((k, x.reshape(v.shape)) for (k, v), x in zip(like.items(), np.split(whole, ends[:-1])))


def window_gradients(net: dict, h: np.ndarray, ids: np.ndarray, start: np.ndarray):
    """Mean loss of a window (streams, steps), its gradients and the last state.

    ``start`` marks the first token of a document, where the state is new. The
    state comes in from the window before; gradients stop there.
    """
    streams, steps = ids.shape
    classes, n, dtype = len(net["member"]), h.shape[1], net["state"].dtype
    ids = np.ascontiguousarray(ids.T)
    states, last, parts = unrolled(recurrence(net), h, ids, start)
    ones, own, states = states.reshape(-1, n + 1), ids.ravel(), states[:, :, :-1]
    head, scale = class_of(own, classes), 1.0 / own.size
    grad = Flat(net, np.zeros(sum(v.size for v in net.values()), dtype))
    (top, top_near), (inner, inner_near) = heads(net, ones)
    loss = 0.0

    def shares(p: np.ndarray, at: np.ndarray, near: bool) -> tuple[np.ndarray, float]:
        """From logits in place to the gradient of their loss, but for a factor of
        each row; that factor and the loss."""
        total, hit, cells = exponentials(p, at, near)
        p.reshape(-1)[cells] -= total
        return (scale / total)[:, None].astype(p.dtype), float((np.log(total) - hit).sum())

    sums, d_states, back = 0, np.empty((own.size, n), dtype), np.ascontiguousarray(net["class"].T)
    held = np.empty((min(BLOCK, len(own)), top.shape[1]), dtype)
    for a in range(0, len(own), BLOCK):
        rows = ones[a : a + BLOCK]
        p = product(rows, top, held[: len(rows)])
        factor, more = shares(p, head[a : a + BLOCK], top_near)
        loss += more
        for part, given in zip(pieces(p), pieces(rows * factor)):
            sums = sums + np.matmul(part.swapaxes(1, 2), given).sum(axis=0)
        d = product(p, back, d_states[a : a + BLOCK])
        d *= factor
    grad["class"][:], grad["class_bias"][:] = sums[:, :-1].T, sums[:, -1]
    order, groups = by_id(own, net["input"].shape[1])
    spans = [x for x in groups if x[0] < classes]
    rows = order[: spans[-1][2] if spans else 0]
    sorted_h, q = ones.take(rows, axis=0), np.empty((len(rows), MEMBERS), dtype)
    for k, a, b in spans:
        np.matmul(sorted_h[a:b], inner[k], out=q[a:b])
    factor, more = shares(q, own[rows] % MEMBERS, inner_near)
    loss += more
    q *= factor
    d_rows, back = np.empty((len(rows), n), dtype), np.ascontiguousarray(net["member"].swapaxes(1, 2))
    sums = np.zeros_like(inner)
    for k, a, b in spans:
        np.matmul(sorted_h[a:b].T, q[a:b], out=sums[k])
        np.matmul(q[a:b], back[k], out=d_rows[a:b])
    grad["member"][:], grad["member_bias"][:] = sums[:, :-1], sums[:, -1]
    d_states[rows] += d_rows
    d_states = d_states.reshape(steps, streams, n)
    back, held = np.ascontiguousarray(net["state"][[2, 0, 1]].swapaxes(1, 2)), np.empty((3, streams, n), dtype)
    dh, new_at = np.zeros_like(last), start.any(axis=0)
    mixed, d = np.empty_like(last), np.empty_like(last)
    for t in range(steps - 1, -1, -1):  # ``parts`` become their gradients
        c, z, r, new = parts[:, t]
        np.subtract(1, z, out=mixed)
        mixed *= dh
        np.subtract(states[t], new, out=d)
        d *= mixed
        dh *= z
        z *= d
        new *= new
        np.subtract(1, new, out=new)
        new *= mixed
        np.subtract(1, r, out=d)
        d *= c
        d *= new
        np.multiply(r, new, out=c)
        r *= d
        for part in np.matmul(parts[:3, t], back, out=held):
            dh += part
        dh += d_states[t]
        if new_at[t]:
            dh *= ~start[:, t, None]
    sums = np.matmul(ones.reshape(steps, streams, n + 1).swapaxes(1, 2), parts[:3]).sum(axis=1)
    grad["state"][[2, 0, 1]] = sums[:, :-1]
    parts = parts.reshape(4, -1, n)
    grad["gate"][:2], grad["gate"][2] = sums[1:, -1], np.ones(own.size, dtype) @ parts[3]
    add_groups(grad["input"], own, parts[1:], order, groups)
    return loss * scale, grad, last


def adam_step(weights: np.ndarray, g: np.ndarray, first: np.ndarray, second: np.ndarray, rate: float, turn: int) -> None:
    """Adam's step number ``turn``, along gradients cut to a length of one, on so
    many weights at a time that they stay in the cache. Overwrites ``g``."""
    cut = min(1.0, 1.0 / (float(np.sqrt(g @ g)) + 1e-9))
    spread = float(np.sqrt(1 - 0.99**turn))
    held = np.empty(min(ADAM_BLOCK, len(g)), g.dtype)
    for a in range(0, len(g), ADAM_BLOCK):
        w, x, m, v = (y[a : a + ADAM_BLOCK] for y in (weights, g, first, second))
        d = held[: len(x)]
        np.multiply(x, 0.1 * cut, out=d)
        m *= 0.9
        m += d
        x *= x
        x *= 0.01 * cut * cut
        v *= 0.99
        v += x
        np.sqrt(v, out=x)
        x += 1e-6 * spread
        np.divide(m, x, out=d)
        d *= rate * spread / (1 - 0.9**turn)
        w -= d


def learn(net: dict, docs: list[np.ndarray], rate: float, seed: int) -> dict:
    """One round over ``docs`` (ids) in parallel streams, with Adam."""
    net = Flat(net, np.concatenate([v.ravel() for v in net.values()]))
    order = np.random.default_rng(seed).permutation(len(docs))
    ids = np.concatenate([docs[i] for i in order])
    start = np.zeros(len(ids), bool)
    start[np.cumsum([0] + [len(docs[i]) for i in order])[:-1]] = True
    streams = max(1, min(STREAMS, len(ids) // (8 * STEPS)))
    length = len(ids) // streams
    whole = streams * length
    tail, tail_start = ids[whole:][None], start[whole:][None]  # goes on where the last stream ends
    ids, start = ids[:whole].reshape(streams, length), start[:whole].reshape(streams, length)
    start[:, 0] = True
    h = np.zeros((streams, net["state"].shape[-1]), np.float32)
    first, second = np.zeros_like(net.whole), np.zeros_like(net.whole)
    turn = 0
    for part, part_start in ((ids, start), (tail, tail_start)):
        h = h[-len(part) :]
        for a in range(0, part.shape[1], STEPS):
            turn += 1
            _, grad, h = window_gradients(net, h, part[:, a : a + STEPS], part_start[:, a : a + STEPS])
            adam_step(net.whole, grad.whole, first, second, rate, turn)
    return dict(net)


def document_scores(net: dict, docs: list[np.ndarray]) -> np.ndarray:
    """ln P of each document's ids. The documents are dealt, longest first, to
    SCORE_DOCS streams of about one length, which are read in step."""
    out, weights, ready, n = np.zeros(len(docs)), recurrence(net), heads(net), net["state"].shape[-1]
    if not docs:
        return out
    sizes = np.array([len(d) for d in docs])
    streams: list[list[int]] = [[] for _ in range(min(SCORE_DOCS, len(docs)))]
    least = [(0, k) for k in range(len(streams))]
    for i in np.argsort(-sizes, kind="stable").tolist():
        length, k = least[0]
        streams[k].append(i)
        heapq.heapreplace(least, (length + int(sizes[i]), k))
    longest = sorted(least, reverse=True)
    turn = np.array([i for _, k in longest for i in streams[k]])
    lengths = np.array([length for length, _ in longest])
    live = np.searchsorted(-lengths, -np.arange(lengths[0]))  # the first so many streams go on at a step
    first = np.cumsum(live) - live
    # Tokens lie by step, then by stream.
    place = first[np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] + np.repeat(np.arange(len(lengths)), lengths)
    ids, of = np.empty(len(place), docs[0].dtype), np.empty(len(place), np.int32)
    ids[place] = np.concatenate([docs[i] for i in turn])
    of[place] = np.repeat(turn, sizes[turn])
    begins = np.sort(place[np.cumsum(sizes[turn]) - sizes[turn]])
    cuts = np.searchsorted(begins, np.append(first, len(place))).tolist()
    live, first = live.tolist(), [*first.tolist(), len(place)]
    held, new = np.empty(3 * live[0] * n, weights[1].dtype), np.empty((live[0], n), weights[1].dtype)
    h, t0 = np.zeros((live[0], n), weights[1].dtype), 0
    while t0 < len(live):
        a = first[t0]
        t1 = max(t0 + 1, bisect.bisect_right(first, a + SCORE_TOKENS) - 1)
        states = np.ones((first[t1] - a, n + 1), new.dtype)
        for t in range(t0, t1):
            m = live[t]
            h = h[:m]
            if cuts[t] < cuts[t + 1]:
                h[begins[cuts[t] : cuts[t + 1]] - first[t]] = 0
            own = states[first[t] - a : first[t + 1] - a]
            own[:, :-1] = h
            h = advance(weights, h, own, ids[first[t] : first[t + 1]], held[: 3 * m * n].reshape(3, m, n), new[:m])
        got = log_probabilities(net, states, ids[a : first[t1]], ready)
        out += np.bincount(of[a : first[t1]], got, len(docs))
        t0 = t1
    return out


# -- whole documents -------------------------------------------------------


class Vocabulary:
    """Ids of words, and log10(count + 0.5) of those whose counts went along."""

    def __init__(self, top: list[str], known: list[str], log_counts: np.ndarray):
        self.size = -(-len(top) // MEMBERS) * MEMBERS
        self.known = pa.array(known, pa.string())
        self.log_count = np.asarray(log_counts, float)
        place = pc.index_in(self.known, value_set=pa.array(top, pa.string()))
        self.id = np.where(place.is_valid(), place.fill_null(0), self.size + shape_classes(self.known)).astype(np.uint16)

    def read(self, texts: pa.Array):
        """The distinct words of ``texts``, their ids, their places among the known
        ones or -1, which of them each token is, and how many tokens each text has."""
        words, sizes = words_of(texts)
        coded = words.dictionary_encode()
        distinct = pa.concat_arrays([coded.dictionary, pa.array([END])])
        token = np.full(len(words) + len(sizes), len(distinct) - 1, np.int32)
        inside = np.ones(len(token), bool)
        inside[np.cumsum(sizes + 1) - 1] = False
        token[inside] = coded.indices.to_numpy()
        place = pc.index_in(distinct, value_set=self.known).fill_null(-1).to_numpy()
        ids, missing = np.empty(len(distinct), np.uint16), np.flatnonzero(place < 0)
        ids[place >= 0] = self.id[place[place >= 0]]
        ids[missing] = self.size + shape_classes(distinct.take(pa.array(missing)))
        return distinct, ids, place, token, sizes + 1


def encoded(rows: DataFrame, words: Vocabulary, base: float, shape_base: np.ndarray) -> DataFrame:
    """doc_id and place of ``rows`` (doc_id, text, place); of each text the
    number of tokens and of those known, the base score of these, what the words of
    shape classes add to the network's score, the other words with their numbers
    in the text, and the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text", TOKEN_BYTES):
                distinct, ids, place, token, sizes = words.read(batch.column("text"))
                row, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
                found = place >= 0
                logs = np.zeros(len(distinct))
                logs[found] = words.log_count[place[found]]
                ours, shaped = logs.copy(), ids >= words.size  # of a word in a shape class: log10(count + 0.5) less the class's total
                ours[~shaped] = 0
                ours[shaped] -= shape_base[ids[shaped] - words.size]
                by_row = lambda x: np.bincount(row, x[token], len(sizes))
                missing = np.flatnonzero(~found[token])
                pairs, times = np.unique(row[missing] * len(distinct) + token[missing], return_counts=True)
                starts = np.searchsorted(pairs, np.arange(len(sizes) + 1) * len(distinct)).astype(np.int32)
                rest = pa.StructArray.from_arrays([distinct.take(pa.array(pairs % len(distinct))), pa.array(times, pa.int64())], ["word", "n"])
                packed = pa.Array.from_buffers(
                    pa.large_binary(), len(sizes), [None, pa.py_buffer(np.append(0, 2 * ends)), pa.py_buffer(ids[token].astype("<u2"))]
                )
                known = by_row(found.astype(float)).astype(np.int64)
                columns = [pa.array(sizes), pa.array(known), pa.array(by_row(logs) - base * sizes), pa.array(by_row(ours))]
                columns += [pa.ListArray.from_arrays(pa.array(starts), rest), packed.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), *columns], names)

    names = ["doc_id", "place", "n_tokens", "n_known", "base", "given", "rest", "ids"]
    return rows.mapInArrow(
        run, "doc_id long, place long, n_tokens long, n_known long, base double, given double, rest array<struct<word:string,n:long>>, ids binary"
    )


def train(dealt: DataFrame, net: dict) -> dict:
    """Learn from all shares of a part side by side and average, a part a round."""
    schema = "share long, weights binary"
    last = dealt.agg(F.max("part"), F.max("share")).first()
    if last[0] is None:
        return net
    parts, shares = last[0] + 1, last[1]
    for turn in range(ROUNDS):
        # As many partitions as asked for: adaptive execution would learn share after share in one task.
        part = dealt.where(F.col("part") == turn % parts).repartition(max(shares + 1, min(4 * (shares + 1), 400)), "share")
        learnt = part.groupBy("share").applyInPandas(_one_share(net, RATE * (1 - turn / ROUNDS) + 1e-3, turn), schema)
        left = shares
        while left > 0:  # 32 nets to one, until one is left
            learnt = learnt.withColumn("to", F.floor(F.col("share") / 32)).groupBy("to").applyInPandas(_mean_net, schema)
            left //= 32
        if (mean := learnt.first()) is not None:  # no document was dealt to the part
            net = pickle.loads(mean["weights"])[1]
    return net


def _one_share(net: dict, rate: float, turn: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keep_freed()
        docs = [np.frombuffer(d, "<u2") for d in sorted(rows["ids"])]
        return pd.DataFrame({"share": rows["share"].iloc[:1], "weights": [pickle.dumps((1, learn(net, docs, rate, turn)))]})

    return run


def _mean_net(rows: pd.DataFrame) -> pd.DataFrame:
    parts = [pickle.loads(w) for w in rows["weights"]]
    total = sum(n for n, _ in parts)
    joined = {k: sum(p[k] * np.float32(n / total) for n, p in parts) for k in parts[0][1]}
    return pd.DataFrame({"share": [int(rows["share"].iloc[0]) // 32], "weights": [pickle.dumps((total, joined))]})


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score
    of each row of ``docs`` (doc_id, text); documents whose crc32(doc_id) is 1
    modulo 5 are held out from learning."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    learnt_from = crc_mod(F.col("doc_id"), 5) != 1
    counts = stage_table(word_counts(rows.where(learnt_from)))
    size = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == END, F.col("n"))).alias("docs")).first()
    total, kinds, documents = size["n"] or 0, size["v"], size["docs"] or 0
    top, known = frequent_words(counts)
    vocabulary = Vocabulary(top, [w for w, _ in known], np.log10(np.array([n for _, n in known]) + 0.5))
    mass, shape_kinds = shape_totals(counts, top)
    base = float(np.log10(total + 0.5 * (kinds + 1)))
    # Documents to learn from are dealt to the parts of the rounds and their shares.
    parts = max(1, min(ROUNDS, documents // LEAST_DOCS))
    shares = max(1, -(-documents // (parts * SHARE_DOCS)))
    place = F.when(learnt_from, F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts * shares)))
    read = encoded(rows.withColumn("place", place), vocabulary, base, np.log10(mass + 0.5 * (shape_kinds + 1)))
    # Row numbers are fixed by the written table, so repeated rows stay apart.
    read = stage_table(read.withColumn("row", F.monotonically_increasing_id()))
    net = None
    if total:
        dealt = read.where(F.col("place").isNotNull())
        dealt = dealt.select((F.col("place") % parts).alias("part"), F.floor(F.col("place") / parts).alias("share"), "ids")
        net = train(dealt, new_network(np.array([n for _, n in known[:TOP]], float), mass, shape_kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        for whole in batches:
            for batch in byte_slices(whole, "ids", SCORE_BYTES):
                got = np.array(batch.column("given"))
                if net is not None:
                    got += document_scores(net, [np.frombuffer(x, "<u2") for x in batch.column("ids").to_pylist()]) / np.log(10)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(got)], [*kept, "net"])

    kept = ["row", "doc_id", "n_tokens", "n_known", "base"]
    scored = read.select(*kept, "given", "ids").mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base double, net double")
    words = read.select("row", F.explode("rest").alias("r")).select("row", F.col("r.word").alias("own"), F.col("r.n").alias("times"))
    met = words.join(counts, F.col("own") == F.col("word"), "left")
    rest = met.groupBy(F.col("row").alias("of")).agg(
        F.sum(F.col("times") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.5)).alias("rest_log"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rest_known"),
    )
    more = F.coalesce("rest_log", F.lit(0.0))
    return scored.join(rest, F.col("row") == F.col("of"), "left").select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        ((F.col("net") + more) if total else (F.col("base") + more)).alias("score"),
    )
