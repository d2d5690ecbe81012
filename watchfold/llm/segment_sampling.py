"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

Segmentations of a text have probabilities proportional to ``exp(alpha * score)`` over its
unigram lattice. Perturbing each log-probability by a Gumbel variable and taking the k largest
draws k different ones without replacement. They are found from the top down, as by an A* search
whose bounds are exact: the largest of a set of Gumbels is itself one, at the set's total
log-probability, so a set of segmentations that share a beginning and then leave a path at some
node can wait in the queue as one value, below the value of the path it leaves, until it is the
largest; then its best member is drawn piece by piece, and what it leaves beside waits in turn.
The (k+1)-th value is the threshold of the inclusion scores
``1 - exp(-exp(log_prob - threshold))``, which are given as logarithms.

All random numbers are hashes of (seed, row key, path, place), so a row's samples depend on
nothing but the row. Lattices fall apart into stretches (``unigram``); a worker keeps the
conditional probabilities of those it has met.

A null or empty text has one segmentation, of no pieces. Texts with fewer than k segmentations
give them all, with inclusion 1. Rows with equal keys and texts give equal samples. An empty
table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfold.llm import unigram
from watchfold.llm.near_dedup import _BASE, _powers, mix
from watchfold.llm.shared import documents, in_worker, ship
from watchfold.llm.tokens import Seen, strings, vocabulary

SAMPLES = 2
ALPHA = 1.0
MOST_KEPT = 300_000  # stretches in a worker's table, about 400 bytes each
CHUNK = 1 << 20      # bytes of text in work at a time
PARTS = 1 << 20      # of a log-probability
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def uniform(keys: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    """Numbers strictly between 0 and 1 for each key and place."""
    bits = mix(keys + (np.atleast_1d(place).astype(np.uint64) + np.uint64(1)) * _GOLDEN)
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def below(location: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at ``location`` given that they are at most ``most``."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        value = location - np.log(np.exp(location - most) - np.log(u))
    return np.where(np.isneginf(location), -np.inf, np.minimum(value, most))


class Lattices:
    """Conditional probabilities of the pieces at every character of the stretches met."""

    def __init__(self, model: unigram.Vocabulary, alpha: float):
        self.model, self.size = model, len(model.texts)
        self.up = _powers(_BASE, 1 << 12)
        self.down = _powers(pow(_BASE, -1, 1 << 64), 1 << 12)
        # Every beginning of a piece, so that longer stretches of text are only looked up where
        # a shorter one can go on; those that are no piece themselves have id -1.
        heads = {p[:n]: -1 for p in model.pieces for n in range(1, len(p) + 1)} | model.pieces
        end = np.cumsum([len(p) for p in heads])
        key = self._keys(self._total(self._points("".join(heads))), end - np.diff(end, prepend=0), end)
        order = np.argsort(key)
        ids = np.array(list(heads.values()))[order]
        self.keys, self.ids, self.scores = key[order], ids, model.scores[ids] * (alpha / unigram.UNIT)
        self.unknown = model.unknown * alpha / unigram.UNIT
        self.seen = Seen()
        self.clear()

    def clear(self) -> None:
        self.seen.clear()
        self.base, self.chars = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)  # by node: its first edge; one more at the end
        self.piece, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int32)
        self.upto, self.logp, self.rest = (np.zeros(0, np.float32) for _ in range(3))

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.replace(" ", unigram.SPACE).encode("utf-32-le"), np.uint32)

    def _total(self, points: np.ndarray) -> np.ndarray:
        if len(points) >= len(self.up):
            n = 1 << int(len(points)).bit_length()
            self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self.up[:len(points)], out=total[1:])
        return total

    def _keys(self, total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def learn(self, stretches: list[str]) -> None:
        points = self._points("".join(stretches))
        chars = np.fromiter(map(len, stretches), np.int64, len(stretches))
        ends = np.repeat(np.cumsum(chars), chars)
        node = np.arange(len(points))
        room = ends - node
        starts, lengths, found, scores = [], [], [], []
        at, n, total = node, 1, self._total(points)
        while len(at):
            key = self._keys(total, at, at + n)
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            if n == 1:  # a character without a piece may be unknown
                odd = at[~hit | (self.ids[place] < 0)]
                starts.append(odd)
                lengths.append(np.ones(len(odd), int))
                found.append(self.size + points[odd].astype(np.int64))
                scores.append(np.full(len(odd), self.unknown))
            at, place = at[hit], place[hit]
            whole = self.ids[place] >= 0
            starts.append(at[whole])
            lengths.append(np.full(int(whole.sum()), n))
            found.append(self.ids[place[whole]])
            scores.append(self.scores[place[whole]])
            n += 1
            at = at[room[at] >= n]
        start, length = np.concatenate(starts), np.concatenate(lengths)
        order = np.argsort(start, kind="stable")
        start, length = start[order], length[order]
        piece, score = np.concatenate(found)[order], np.concatenate(scores)[order]
        first = np.searchsorted(start, np.arange(len(points) + 1))

        # Log of the sum over all ways to the stretch's end, from its last character back.
        beyond = np.zeros(len(points) + 1)
        value = np.zeros(len(start))
        by_room = np.argsort(room, kind="stable")
        cuts = np.searchsorted(room[by_room], np.arange(1, room.max() + 2)) if len(room) else [0]
        is_end = start + length == ends[start]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            nodes = by_room[a:b]
            n = first[nodes + 1] - first[nodes]
            bounds = np.cumsum(n) - n
            edge = np.repeat(first[nodes] - bounds, n) + np.arange(int(n.sum()))
            v = score[edge] + np.where(is_end[edge], 0.0, beyond[start[edge] + length[edge]])
            top = np.maximum.reduceat(v, bounds)
            beyond[nodes] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, n)), bounds))
            value[edge] = v
        # Whole parts of a power of two: their sums are exact in any order.
        logp = np.round((value - beyond[start]) * PARTS) / PARTS
        p = np.exp(logp)
        n = np.diff(first)
        upto = p.copy()
        rank = np.arange(len(start)) - first[start]
        for r in range(1, int(n.max(initial=0))):
            edge = np.flatnonzero(rank == r)
            upto[edge] += upto[edge - 1]
        upto[first[1:] - 1] = 1
        # The others' share: 1 - p is inexact where p is nearly 1, their sum is not.
        small = np.add.reduceat(np.where(p < 0.5, p, 0), first[:-1])[start] if len(start) else p
        n = n[start]
        with np.errstate(divide="ignore"):
            rest = np.where(n == 1, -np.inf, np.log(np.where(p < 0.5, 1 - p, small)))
        self.base = np.concatenate([self.base, len(self.first) - 1 + np.cumsum(chars) - chars])
        self.chars = np.concatenate([self.chars, chars])
        self.first = np.concatenate([self.first, self.first[-1] + first[1:]])
        self.piece = np.concatenate([self.piece, piece.astype(np.uint32)])
        self.length = np.concatenate([self.length, length.astype(np.int32)])
        self.upto = np.concatenate([self.upto, upto.astype(np.float32)])
        self.logp = np.concatenate([self.logp, logp.astype(np.float32)])
        self.rest = np.concatenate([self.rest, rest.astype(np.float32)])

    def walk(self, node: np.ndarray, left: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Draw pieces from each node for ``left`` characters: (edges, nodes, start number), in
        the order of the starts."""
        edges, nodes, owners = [], [], []
        at = np.flatnonzero(left > 0)
        node, left, keys = node[at], left[at], keys[at]
        step = 0
        while len(at):
            u = uniform(keys, step).astype(np.float32)
            edge = self.first[node]
            open_ = np.flatnonzero(u > self.upto[edge])
            while len(open_):
                edge[open_] += 1
                open_ = open_[u[open_] > self.upto[edge[open_]]]
            edges.append(edge)
            nodes.append(node)
            owners.append(at)
            length = self.length[edge]
            left = left - length
            go = left > 0
            node, left, keys, at = (node + length)[go], left[go], keys[go], at[go]
            step += 1
        if not edges:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(edges)[order], np.concatenate(nodes)[order], owner[order]


class Path:
    """One sample of every text of a chunk: pieces in a row, and the waiting sets beside them."""

    def __init__(self, lattices: Lattices, texts: np.ndarray, bounds: np.ndarray, edges: np.ndarray, nodes: np.ndarray,
                 stretch: np.ndarray, value: np.ndarray, keys: np.ndarray, left_at: np.ndarray, left_out: list):
        self.texts, self.bounds, self.edges, self.nodes, self.stretch = texts, bounds, edges, nodes, stretch
        self.value, self.left_at, self.left_out = value, left_at, left_out
        n = np.diff(bounds)
        own = np.repeat(np.arange(len(texts)), n)
        logp = lattices.logp[edges].astype(np.float64)
        total = np.concatenate([[0.0], np.cumsum(logp)])
        self.log_prob = total[bounds[1:]] - total[bounds[:-1]]
        before = total[:-1] - total[bounds[:-1]][own]
        place = np.arange(len(edges)) - bounds[:-1][own]
        mass = before + lattices.rest[edges]
        # What lies beside the beginning that a path shares waits with the path it left.
        mass[place < left_at[own]] = -np.inf
        for t in np.flatnonzero(left_at >= 0):
            i = bounds[t] + left_at[t]
            out = left_out[t]
            a, b = lattices.first[nodes[i]], lattices.first[nodes[i] + 1]
            others = [e for e in range(a, b) if e not in out]
            mass[i] = before[i] + np.log(np.exp(lattices.logp[others].astype(np.float64)).sum()) if others else -np.inf
        self.wait = below(mass, value[own], uniform(keys[own], place))
        self.best = np.full(len(texts), -np.inf)
        self.find(np.arange(len(texts)))

    def find(self, which: np.ndarray) -> None:
        """The largest waiting value of these texts."""
        some = which[self.bounds[which + 1] > self.bounds[which]]
        if len(some) == len(self.texts):
            self.best = np.maximum.reduceat(self.wait, self.bounds[:-1])
        else:
            for t in some.tolist():
                self.best[t] = self.wait[self.bounds[t]:self.bounds[t + 1]].max()


class Sampler:
    def __init__(self, model: unigram.Vocabulary, alpha: float, seed: int):
        self.lattices, self.seed = Lattices(model, alpha), seed
        self.pieces = pa.array([t for t in model.texts], pa.large_binary())
        self.byte_ids = np.array(model.byte_ids)

    def chunk(self, data: np.ndarray, bounds: np.ndarray, keys: np.ndarray, samples: int):
        """(paths, threshold of each text); text numbers in a path are those of the chunk."""
        lattices = self.lattices
        start = unigram.starts(data, bounds)
        row = lattices.seen.find(data, start, np.append(start[1:], len(data)), lattices.learn)
        of = np.searchsorted(bounds, start, "right") - 1
        per = np.searchsorted(of, np.arange(len(bounds)))
        texts = np.flatnonzero(np.diff(per) > 0)
        per = np.append(per[texts], len(row))
        base, chars = lattices.base[row], lattices.chars[row]
        stretch_in = np.arange(len(row)) - np.repeat(per[:-1], np.diff(per))
        keys = mix(keys[texts] + mix(np.array([self.seed + 1], np.uint64)))

        def stretch_keys(turn: int, which: np.ndarray, of_text: np.ndarray) -> np.ndarray:
            return mix(keys[of_text] + mix(stretch_in[which].astype(np.uint64) * np.uint64(64) + np.uint64(turn + 1)))

        own = np.repeat(np.arange(len(texts)), np.diff(per))
        all_ = np.arange(len(row))
        edges, nodes, owner = lattices.walk(base, chars, stretch_keys(0, all_, own))
        cuts = np.searchsorted(owner, per)
        value = -np.log(-np.log(uniform(keys, 0)))
        paths = [Path(lattices, np.arange(len(texts)), cuts, edges, nodes, owner, value, mix(keys + np.uint64(3)),
                      np.full(len(texts), -1), [None] * len(texts))]
        for turn in range(1, samples):
            best, source = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
            for p, path in enumerate(paths):
                better = path.best > best[path.texts]
                best[path.texts[better]], source[path.texts[better]] = path.best[better], p
            chosen = np.flatnonzero(best > -np.inf)
            if not len(chosen):
                break
            heads, left_at, left_out, again, node, left = [], [], [], [], [], []
            slots = []
            for t in chosen.tolist():
                path = paths[source[t]]
                slot = int(np.searchsorted(path.texts, t))
                a, b = path.bounds[slot], path.bounds[slot + 1]
                i = a + int(path.wait[a:b].argmax())
                path.wait[i] = -np.inf
                slots.append((path, slot))
                at = path.nodes[i]
                out = path.left_out[slot] if path.left_at[slot] == i - a else frozenset([int(path.edges[i])])
                choices = [e for e in range(lattices.first[at], lattices.first[at + 1]) if e not in out]
                share = np.cumsum(np.exp(lattices.logp[choices].astype(np.float64)))
                u = uniform(keys[t:t + 1], 1000 + turn)[0] * share[-1]
                edge = choices[min(int(np.searchsorted(share, u)), len(choices) - 1)]
                stretch = int(path.stretch[i])
                heads.append((path, a, i, edge, at, stretch))
                left_at.append(i - a)
                left_out.append(out | {edge})
                again.append(np.arange(stretch, per[t + 1]))
                n, after = base[stretch:per[t + 1]].copy(), chars[stretch:per[t + 1]].copy()
                gone = at + lattices.length[edge] - n[0]
                n[0], after[0] = n[0] + gone, after[0] - gone
                node.append(n)
                left.append(after)
            for path in paths:
                path.find(np.array([s for p, s in slots if p is path], np.int64))
            which = np.concatenate(again)
            of_text = np.repeat(chosen, [len(w) for w in again])
            edges, nodes, owner = lattices.walk(np.concatenate(node), np.concatenate(left), stretch_keys(turn, which, of_text))
            tails = np.searchsorted(owner, np.cumsum([0, *(len(w) for w in again)])).tolist()
            owner = which[owner]
            new = [[], [], []]
            size = [0]
            for k, (path, a, i, edge, at, stretch) in enumerate(heads):
                x, y = tails[k], tails[k + 1]
                new[0] += [path.edges[a:i], [edge], edges[x:y]]
                new[1] += [path.nodes[a:i], [at], nodes[x:y]]
                new[2] += [path.stretch[a:i], [stretch], owner[x:y]]
                size.append(int(i - a) + 1 + y - x)
            edges, nodes, owner = (np.concatenate(x).astype(np.int64) for x in new)
            paths.append(Path(lattices, chosen, np.cumsum(size), edges, nodes, owner, best[chosen],
                              mix(keys[chosen] + np.uint64(3 + turn)), np.array(left_at), left_out))
        threshold = np.full(len(texts), -np.inf)
        for path in paths:
            threshold[path.texts] = np.maximum(threshold[path.texts], path.best)
        return texts, paths, threshold

    def ids(self, edges: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, unknown characters as their bytes, and the bounds of the texts."""
        piece = self.lattices.piece[edges].astype(np.int64)
        odd = np.flatnonzero(piece >= self.lattices.size)
        if not len(odd):
            return piece, bounds
        raw = [chr(c).encode() for c in (piece[odd] - self.lattices.size).tolist()]
        n = np.ones(len(piece), np.int64)
        n[odd] = [len(b) for b in raw]
        to = np.concatenate([[0], np.cumsum(n)])
        out = np.repeat(piece, n)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        out[np.repeat(to[odd], n[odd]) + np.arange(len(flat)) - np.repeat(np.cumsum(n[odd]) - n[odd], n[odd])] = self.byte_ids[flat]
        return out, to[bounds]

    def text(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of ids in a row, each less its first space."""
        flat = self.pieces.take(pa.array(ids))
        offsets = np.frombuffer(flat.buffers()[1], np.int64)[:len(ids) + 1]
        data = flat.buffers()[2] or pa.py_buffer(b"")
        whole = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets[bounds].copy()), data])
        return whole


def sampler(path: str | None, alpha: float, seed: int) -> Sampler:
    place = path or vocabulary("piece_bpe_32k.model")
    return in_worker(("sample", place, alpha, seed), lambda: Sampler(unigram.load(place), alpha, seed))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES,
           alpha: float = ALPHA, seed: int = 0, path: str | None = None) -> DataFrame:
    """Rows (id, rank from 1, ids, log_prob, perturbed, log_inclusion, round_trip). ``ids`` are
    little-endian unsigned 16-bit numbers; ``round_trip`` tells that they decode to the text."""
    ship(docs.sparkSession)

    def run(batches):
        own = sampler(path, alpha, seed)
        for batch in batches:
            data, offsets = strings(pc.replace_substring(batch.column(2), unigram.SPACE, " "))
            all_keys = batch.column(1).to_numpy().view(np.uint64)
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1
                to = min(max(to, at + 1), batch.num_rows)
                part, bounds = unigram.spaced(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
                empty = np.flatnonzero(np.diff(bounds) == 0)
                names = batch.column(0).slice(at, to - at)
                if len(empty):
                    yield rows(names.take(pa.array(empty)), 1, np.zeros(0, int), np.zeros(len(empty) + 1, int),
                               np.zeros(len(empty)), np.zeros(len(empty)), np.zeros(len(empty)), np.ones(len(empty), bool))
                if len(part):
                    keys = mix(all_keys[at:to].copy())
                    texts, paths, threshold = own.chunk(part, bounds, keys, samples)
                    source = pa.Array.from_buffers(pa.large_binary(), to - at, [
                        None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(part)])
                    for rank, p in enumerate(paths):
                        ids, cuts = own.ids(p.edges, p.bounds)
                        here = pa.array(texts[p.texts])
                        same = pc.equal(own.text(ids, cuts), source.take(here)).to_numpy(zero_copy_only=False)
                        above = p.log_prob - threshold[p.texts]
                        with np.errstate(over="ignore", divide="ignore"):
                            # Far below 0 the logarithm of the inclusion is the difference itself.
                            inclusion = np.where(above < -30, above, np.log(-np.expm1(-np.exp(above))))
                        yield rows(names.take(here), rank + 1, ids, cuts, p.log_prob, p.value, inclusion, same)
                    if len(own.lattices.chars) > MOST_KEPT:
                        own.lattices.clear()
                at = to

    def rows(names, rank, ids, cuts, log_prob, value, inclusion, same):
        binary = pa.Array.from_buffers(pa.binary(), len(names), [
            None, pa.py_buffer((cuts * 2).astype(np.int32)), pa.py_buffer(ids.astype("<u2"))])
        return pa.RecordBatch.from_arrays(
            [names, pa.array(np.full(len(names), rank, np.int32)), binary, pa.array(log_prob), pa.array(value),
             pa.array(inclusion), pa.array(same)],
            names=[id_col, "rank", "ids", "log_prob", "perturbed", "log_inclusion", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col), F.xxhash64(id_col).alias("_key"), F.col(text_col))
    return keyed.mapInArrow(run, f"`{id_col}` {kind}, rank int, ids binary, log_prob double, perturbed double, "
                                 "log_inclusion double, round_trip boolean")


def decode(encoded: DataFrame, ids_col: str = "ids", into: str = "text", path: str | None = None) -> DataFrame:
    """``encoded`` with the text of its ids; bytes that are no UTF-8 become U+FFFD, null stays."""
    ship(encoded.sparkSession)

    def text(column: pa.Array) -> pa.Array:
        own = sampler(path, ALPHA, 0)
        texts = []
        for value in column.to_pylist():
            if value is None:
                texts.append(None)
                continue
            ids = np.frombuffer(value, "<u2").astype(np.int64)
            whole = own.text(ids, np.array([0, len(ids)]))[0].as_py()
            texts.append((whole[1:] if whole[:1] == b" " else whole).decode("utf-8", "replace"))
        return pa.array(texts, pa.string())

    return encoded.withColumn(into, F.arrow_udf(text, "string")(F.col(ids_col)))


def op1_gumbel_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sample(documents(spark, sf_dir))
    return out.select("doc_id", "rank", (F.octet_length("ids") / 2).cast("long").alias("n_tokens"),
                      F.crc32("ids").alias("ids_crc32"), "log_prob", "perturbed", "log_inclusion", "round_trip")
