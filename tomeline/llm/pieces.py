"""SentencePiece encoding by Gumbel top-k without replacement, and decoding.

The lattice of a text has an edge for every piece of a vocabulary file that fits at a
place; characters without a piece fall back to their bytes.  A piece's weight follows
Zipf's law on its place in the vocabulary (the files hold merge ranks, no
probabilities), and a segmentation's probability is the product of its pieces' weights,
normalised over all segmentations.  A piece may begin with spaces or be a run of them, but
none crosses into a space or line break, so a text is a chain of units (a word with the
spaces before it), and a worker builds the lattice of a unit once for many batches.

Sampling without replacement is an A-star search over perturbed log-probabilities.  The
set of all segmentations gets a Gumbel number as its perturbed maximum.  The best set is
taken out again and again; a segmentation is drawn from it edge by edge and keeps the
set's maximum, and at each of its places the segmentations that leave it there form a
new set, whose maximum is a Gumbel number at that set's log-probability, truncated at the
maximum of the set they came from.  Backward sums over the lattice make each set's
log-probability, the search's bound, exact.  The first k are the top k; the best
remaining set gives the threshold for the inclusion scores.  All random numbers are
hashes of the row's key and the place, so a row gives the same samples anywhere.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeline.llm.common import Met, ragged, release_memory, slices_by_chars

SPACE = "▁"
MARK = "\ud800"  # no text of Spark's holds a lone surrogate
LONG = 512  # units of more characters are walked one by one
BYTE_EDGE = 1 << 20  # ids from here on stand for the bytes of one character
U = np.uint64


class Vocabulary:
    """Pieces as a trie over code points, weights, and the bytes of every id."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.size = n
        self.weight = -np.log(np.arange(n) + 2.7)
        self.byte_weight = float(-np.log(2.0 * n))
        self.byte_ids = np.zeros(256, dtype=np.int64)
        raw: list[bytes] = []
        children: dict[tuple[int, int], int] = {}
        piece_of = [-1]
        for i in range(n):
            text = sp.id_to_piece(i)
            raw.append(b"")
            if sp.is_byte(i):
                self.byte_ids[int(text[3:5], 16)] = i
                raw[-1] = bytes([int(text[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                raw[-1] = text.replace(SPACE, " ").encode()
                if text.strip(SPACE) and SPACE in text[1:]:
                    continue  # a piece that would cross a unit's end
                node = 0
                for c in text:
                    node = children.setdefault((node, ord(c)), len(piece_of))
                    if node == len(piece_of):
                        piece_of.append(-1)
                piece_of[node] = i
        keys = np.array([(a << 21) | c for a, c in children], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(children.values()), dtype=np.int64)[order]
        self.piece_of = np.array(piece_of, dtype=np.int64)
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_length = np.array([len(x) for x in raw], dtype=np.int64)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids as UTF-8: spaces for their marks, without the first one."""
        at = ragged(self.raw_start[ids], self.raw_length[ids])
        return self.raw[at][1:].tobytes()


class Lattices:
    """The lattices of distinct units, as edges sorted by the place they leave.

    A worker keeps those of units it meets again from batch to batch, up to ``most_edges``
    edges (24 bytes each), and starts anew when they are more.  The others stay for one
    batch, behind the kept ones.
    """

    KINDS = {"frm": np.int32, "to": np.int32, "ids": np.int32, "logp": np.float64, "share": np.float32, "begin": np.int32, "first": np.int32, "last": np.int32}

    def __init__(self, vocab: Vocabulary, most_edges: int = 1_500_000):
        self.vocab, self.most_edges, self.met = vocab, most_edges, Met()
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.used = dict.fromkeys(self.KINDS, 0)
        for n, kind in self.KINDS.items():
            setattr(self, n, np.zeros(1, kind))

    def add(self, built: dict[str, np.ndarray]) -> None:
        """Append lattices; arrays grow by a half, and what follows the used part stands for the end."""
        place, edge = self.used["begin"], self.used["frm"]
        for name, values in built.items():
            old, used = getattr(self, name), self.used[name]
            if used + len(values) + 1 > len(old):
                grown = np.empty((used + len(values) + 1) * 3 // 2, old.dtype)
                grown[:used] = old[:used]
                setattr(self, name, grown)
            getattr(self, name)[used : used + len(values)] = values + {"frm": place, "to": place, "first": place, "last": place, "begin": edge}.get(name, 0)
            self.used[name] = used + len(values)
        self.begin[self.used["begin"]] = self.used["frm"]

    def find(self, keys: pa.Array) -> np.ndarray:
        """The numbers of distinct units by their keys (see ``unit_of``), until the next call; lattices of unknown ones are built."""
        if self.used["frm"] > self.most_edges:
            self.forget()
        number = pc.fill_null(pc.index_in(keys, value_set=self.known), -1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(number < 0)
        units = [unit_of(k) for k in keys.take(pa.array(missing)).to_numpy(zero_copy_only=False)]
        again = self.met.again(units)
        for some in (again, ~again):
            found = np.flatnonzero(some)
            start, kept = self.used["first"], dict(self.used)
            for at in range(0, len(found), 16_384):
                self.add(self.build([units[i] for i in found[at : at + 16_384].tolist()]))
            number[missing[found]] = start + np.arange(len(found))
            if some is again:
                self.known = pa.concat_arrays([self.known, keys.take(pa.array(missing[found]))])
            else:
                self.used = kept
        return number

    def build(self, units: list[str]) -> dict[str, np.ndarray]:
        """First and last place of each unit, each place's first edge, and all edges."""
        vocab = self.vocab
        lengths = np.array([len(u) for u in units], dtype=np.int64)
        # every unit has a place before each character and one after the last
        first = np.cumsum(lengths + 1) - (lengths + 1)
        last = first + lengths
        places = int((lengths + 1).sum())
        chars = np.frombuffer(("\0".join(units) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        end = np.repeat(last, lengths + 1)
        frm, to, ids = self.fit(chars, end, vocab)
        bare = np.ones(places, dtype=bool)
        bare[last] = False
        bare[frm[to == frm + 1]] = False
        bare = np.flatnonzero(bare)
        code = chars[bare]
        width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        weight = np.concatenate([vocab.weight[ids], width * vocab.byte_weight])
        frm, to, ids = (np.concatenate(x).astype(np.int32) for x in ((frm, bare), (to, bare + 1), (ids, BYTE_EDGE + code)))
        order = order_by(frm)
        frm, to, ids, weight = frm[order], to[order], ids[order], weight[order]
        long = np.flatnonzero(lengths > LONG)
        beta = self.backward(places, end, frm, to, weight, np.repeat(lengths <= LONG, lengths + 1))
        for i in long.tolist():
            at = slice(*np.searchsorted(frm, (first[i], last[i])))
            beta[first[i] : last[i] + 1] = self.backward_one(int(lengths[i]), frm[at] - first[i], to[at] - first[i], weight[at])
        logp = weight + beta[to] - beta[frm]
        order = order_by(frm, 1 - np.minimum(np.exp(logp), 1.0))  # a place's likeliest edge first: draws take few steps
        to, ids, logp = to[order], ids[order], logp[order]
        begin = np.searchsorted(frm, np.arange(places + 1))
        p = np.exp(logp)
        total = np.cumsum(p)
        share = total - np.concatenate([[0.0], total])[begin[frm]]
        closing = begin[frm + 1] - 1
        share /= share[closing]
        share[closing] = 1.0
        return {"frm": frm, "to": to, "ids": ids, "logp": np.minimum(logp, 0.0), "share": share, "begin": begin[:-1], "first": first, "last": last}

    def draw(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """For each place the first edge whose summed probability exceeds a number below 1."""
        edge = self.begin[place]
        todo = np.flatnonzero(self.share[edge] <= u)
        while len(todo):
            edge[todo] += 1
            todo = todo[self.share[edge[todo]] <= u[todo]]
        return edge

    def draw_on(self, place: int, stop: int, u: list[float]) -> list[int]:
        """The edges of one long unit from a place on; ``u`` has a number for each place."""
        start, base = place, int(self.begin[place])
        share, to = self.share[base : self.begin[stop]].tolist(), self.to[base : self.begin[stop]].tolist()
        begin, out = self.begin[place:stop].tolist(), []
        while place < stop:
            e = begin[place - start] - base
            while share[e] <= u[place - start]:
                e += 1
            out.append(e + base)
            place = to[e]
        return out

    @staticmethod
    def fit(chars: np.ndarray, end: np.ndarray, vocab: Vocabulary):
        """Edges of all pieces: one walk down the trie from every place at once."""
        start = np.flatnonzero(np.arange(len(end)) < end)
        node, depth = np.zeros(len(start), dtype=np.int64), 0
        out: list[tuple] = []
        while len(start):
            key = (node << 21) | chars[start + depth]
            at = np.minimum(np.searchsorted(vocab.keys, key), len(vocab.keys) - 1)
            hit = vocab.keys[at] == key
            start, node, depth = start[hit], vocab.child[at[hit]], depth + 1
            piece = vocab.piece_of[node]
            whole = piece >= 0
            out.append((start[whole], start[whole] + depth, piece[whole]))
            more = start + depth < end[start]
            start, node = start[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    @staticmethod
    def backward(places: int, end: np.ndarray, frm: np.ndarray, to: np.ndarray, weight: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Log of the summed weights of all ways from each place to its unit's end, by distance from it."""
        beta = np.zeros(places)
        away = np.where(among, end - np.arange(places), 0)[frm]
        order = np.argsort(away, kind="stable")
        bounds = np.searchsorted(away[order], np.arange(1, int(away.max(initial=0)) + 2))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            edges = order[lo:hi]
            if not len(edges):
                continue
            value, start = weight[edges] + beta[to[edges]], frm[edges]
            fresh = np.flatnonzero(np.r_[True, start[1:] != start[:-1]])
            top = np.maximum.reduceat(value, fresh)
            total = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(np.r_[fresh, len(value)]))), fresh)
            beta[start[fresh]] = top + np.log(total)
        return beta

    @staticmethod
    def backward_one(length: int, frm: np.ndarray, to: np.ndarray, weight: np.ndarray) -> list[float]:
        """The same for one long unit, place by place."""
        beta, exp = [0.0] * (length + 1), math.exp
        bounds, to, weight = np.searchsorted(frm, np.arange(length + 1)).tolist(), to.tolist(), weight.tolist()
        for place in range(length - 1, -1, -1):
            value = [weight[e] + beta[to[e]] for e in range(bounds[place], bounds[place + 1])]
            top = max(value)
            beta[place] = top + math.log(sum([exp(v - top) for v in value]))
        return beta


def unit_of(key: str) -> str:
    """The text of a unit from its key: a word, a line break with what follows, or (after two
    line breaks) the number of spaces before a word.  A mark in the text itself becomes
    ``MARK``, which has no piece and is coded by its bytes; only a unit's own marks are pieces."""
    if key.startswith("\n\n"):
        spaces, _, key = key[2:].partition(" ")
        return SPACE * int(spaces) + key.replace(SPACE, MARK)
    return key.replace(SPACE, MARK) if key[:1] == "\n" else SPACE + key.replace(SPACE, MARK)


def order_by(major: np.ndarray, minor: np.ndarray | None = None) -> np.ndarray:
    """The order by ``major``, then by ``minor`` (from 0 to 1, to a millionth part), then by place."""
    if len(major) >= 1 << 22:
        return np.argsort(major if minor is None else major + minor * 0.99, kind="stable")
    key = major.astype(np.int64) << 42 | np.arange(len(major))
    if minor is not None:
        key |= (minor * ((1 << 20) - 1)).astype(np.int64) << 22
    return np.sort(key) & ((1 << 22) - 1)


STORES: dict[str, Lattices] = {}


def lattices(path: str) -> Lattices:
    """One store for each worker process, kept from task to task."""
    if path not in STORES:
        STORES[path] = Lattices(Vocabulary(path))
    return STORES[path]


def uniform(seed: np.ndarray, a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on a row's seed and two counters only."""
    h = seed + a.astype(U) * U(0x9E3779B97F4A7C15) + (b.astype(U) * U(64) + U(salt)) * U(0xD1B54A32D192ED03)
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return ((h ^ (h >> U(31))) >> U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def truncated(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers at a location, given that they are below a bound."""
    with np.errstate(over="ignore", divide="ignore"):
        return location - np.log(np.exp(location - bound) - np.log(u))


class Batch:
    """Texts of a batch as chains of units, and the search over them."""

    def __init__(self, texts: list[str], seeds: np.ndarray, store: Lattices):
        self.vocab, self.lattices, self.seeds = store.vocab, store, seeds.astype(U)
        words = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        counts = np.diff(words.offsets.to_numpy())
        coded = words.values.dictionary_encode()
        keys, word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), counts)
        keep = ~np.repeat(np.array([not t for t in texts], dtype=bool), counts)
        word, doc = word[keep], doc[keep]
        bare = pc.index(keys, "").as_py()
        if bare >= 0 and len(word):
            word, doc, keys = self.join_spaces(word, doc, keys, bare)
        self.docs = len(texts)
        self.unit = store.find(keys)[word]
        self.doc_of = doc
        self.unit_end = np.cumsum(np.bincount(doc, minlength=self.docs))
        self.unit_begin = np.r_[0, self.unit_end[:-1]]

    @staticmethod
    def join_spaces(word: np.ndarray, doc: np.ndarray, keys: pa.Array, empty: int):
        """Runs of spaces join the word after them, or stand alone before a line break or the end."""
        bare = word == empty
        fresh = np.flatnonzero(np.r_[True, (bare[1:] != bare[:-1]) | (doc[1:] != doc[:-1])])
        run = np.zeros(len(word), dtype=np.int64)  # the bare words right before each word
        size = np.diff(np.r_[fresh, len(word)])
        after = fresh + size
        inner = bare[fresh] & (after < len(word))
        inner[inner] = doc[after[inner]] == doc[fresh[inner]]
        broken = pc.starts_with(keys, "\n").to_numpy(zero_copy_only=False)
        inner[inner] = ~broken[word[after[inner]]]
        run[after[inner]] = size[inner]
        alone = fresh[bare[fresh] & ~inner]
        run[alone] = size[bare[fresh] & ~inner] - 1
        keep = ~bare
        keep[alone] = True
        word, doc, run = word[keep], doc[keep], run[keep]
        some = np.flatnonzero(run)
        pairs, number = np.unique(np.stack([word[some], run[some]]), axis=1, return_inverse=True)
        word[some] = len(keys) + number
        joined = [f"\n\n{n + 1} {keys[w].as_py()}" for w, n in pairs.T.tolist()]
        return word, doc, pa.concat_arrays([keys, pa.array(joined, pa.large_string())])

    def walk(self, occurrences: np.ndarray, places: np.ndarray, round_: int):
        """Draw each unit's edges from a place to its end: (edges, occurrences) in reading order."""
        lat, steps = self.lattices, []
        stop = lat.last[self.unit[occurrences]]
        index = np.flatnonzero(places < stop)
        place = places[index]
        within = occurrences - self.unit_begin[self.doc_of[occurrences]]
        seed = self.seeds[self.doc_of[occurrences]]
        first = lat.first[self.unit[occurrences]].astype(np.int64)
        count = np.zeros(len(occurrences), dtype=np.int64)
        while len(index) and len(steps) < LONG:
            u = uniform(seed[index], within[index], place - first[index], 2 * round_)
            edge = lat.draw(place, u)
            steps.append((index, edge))
            count[index] += 1
            place = lat.to[edge]
            more = place < stop[index]
            index, place = index[more], place[more]
        rest = []
        for i, at in zip(index.tolist(), place.tolist(), strict=True):
            there = np.arange(at, stop[i]) - first[i]
            u = uniform(np.full(len(there), seed[i]), np.full(len(there), within[i]), there, 2 * round_)
            rest.append((i, int(count[i]), lat.draw_on(at, int(stop[i]), u.tolist())))
        for i, _, found in rest:
            count[i] += len(found)
        start = np.cumsum(count) - count
        edges = np.empty(int(count.sum()), dtype=np.int64)
        for i, (index, edge) in enumerate(steps):
            edges[start[index] + i] = edge
        for i, done, found in rest:
            edges[start[i] + done : start[i] + count[i]] = found
        return edges, np.repeat(occurrences, count)

    def alternatives(self, doc: np.ndarray, edges: np.ndarray, occ: np.ndarray, lead: np.ndarray, bound: np.ndarray, begin: np.ndarray, round_: int) -> np.ndarray:
        """For each drawn edge, the perturbed maximum of the ways that leave the path there.

        ``begin`` holds each document's first edge, ``lead`` its log-probability before that.
        """
        lat = self.lattices
        own = lat.logp[edges]
        total = np.cumsum(own) - own
        prefix = total - total[begin[doc]] + lead[doc] if len(edges) else total
        with np.errstate(divide="ignore"):
            location = prefix + np.log1p(-np.exp(own))
        only = lat.begin[lat.frm[edges] + 1] - lat.begin[lat.frm[edges]] == 1
        place = lat.frm[edges] - lat.first[self.unit[occ]]
        u = uniform(self.seeds[doc], occ - self.unit_begin[doc], place, 2 * round_ + 1)
        value = truncated(location, bound[doc], u)
        value[only | ~np.isfinite(location)] = -np.inf
        return value

    def topk(self, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each round: (documents, ids per document as offsets and flat, log-probability, perturbed value), and thresholds."""
        lat, n = self.lattices, self.docs
        every = np.arange(n)
        root = -np.log(-np.log(uniform(self.seeds, np.zeros(n, np.int64), np.full(n, 1 << 40), 63)))
        heaps: list[list[tuple]] = [[] for _ in range(n)]
        paths, rounds = [], []
        active, bound = every, root
        lead, cut, parent, turn = np.zeros(n), np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
        for r in range(k):
            if not len(active):
                break
            # the tail of each active document: the units after its turn, and the rest of the unit of the turn
            first_occ = np.where(turn >= 0, 0, self.unit_begin[active])
            for i in np.flatnonzero(turn >= 0):
                first_occ[i] = paths[parent[i]][2][paths[parent[i]][1][active[i]] + cut[i]]
            tail_count = self.unit_end[active] - first_occ
            occ = ragged(first_occ, tail_count)
            places = lat.first[self.unit[occ]]
            turned = turn >= 0
            at = (np.cumsum(tail_count) - tail_count)[turned]
            places[at] = lat.to[turn[turned]]
            edges, of = self.walk(occ, places, r)
            doc = self.doc_of[of]
            tail = np.bincount(doc, minlength=n)
            begin = np.cumsum(tail) - tail
            leads, bounds = np.zeros(n), np.zeros(n)
            leads[active] = lead + np.where(turned, lat.logp[np.maximum(turn, 0)], 0.0)
            bounds[active] = bound
            value = self.alternatives(doc, edges, of, leads, bounds, begin, r)
            # whole paths: prefix of the parent, the turn, the tail
            size = np.where(turned, cut + 1, 0)
            offset = np.zeros(n + 1, np.int64)
            full = np.zeros(n, np.int64)
            full[active] = size + tail[active]
            offset[1:] = np.cumsum(full)
            flat, flat_occ = np.empty(offset[-1], np.int64), np.empty(offset[-1], np.int64)
            to = ragged(offset[active] + size, tail[active])
            flat[to], flat_occ[to] = edges, of
            for i in np.flatnonzero(turned):
                d, (old, old_offset, old_occ) = active[i], paths[parent[i]]
                a, b = offset[d], old_offset[d]
                flat[a : a + cut[i]], flat_occ[a : a + cut[i]] = old[b : b + cut[i]], old_occ[b : b + cut[i]]
                flat[a + cut[i]], flat_occ[a + cut[i]] = turn[i], old_occ[b + cut[i]]
            paths.append((flat, offset, flat_occ))
            logp = np.zeros(n)
            logp[active] = leads[active]
            logp += np.bincount(doc, lat.logp[edges], n)
            rounds.append((active, offset, flat, logp[active], bound))
            # sets that leave this path, best first; no more of them can be needed than rounds remain
            for _ in range(k - r):
                if not len(value):
                    break
                some = np.flatnonzero(tail)
                top = np.full(n, -np.inf)
                top[some] = np.maximum.reduceat(value, begin[some])
                hit = np.flatnonzero((value == top[doc]) & (value > -np.inf))
                if not len(hit):
                    break
                _, one = np.unique(doc[hit], return_index=True)
                for j in hit[one]:
                    d = doc[j]
                    heapq.heappush(heaps[d], (-value[j], r, int(j - begin[d] + offset[d + 1] - offset[d] - tail[d]), (int(edges[j]),)))
                value[hit[one]] = -np.inf
            active, bound, lead, cut, parent, turn = self.next_turns(active, heaps, paths, r, last=r == k - 1)
        threshold = np.array([-h[0][0] if h else -np.inf for h in heaps])
        return rounds, threshold

    def next_turns(self, active, heaps, paths, r: int, last: bool):
        """Take each document's best set, draw the edge by which it leaves, and put the rest of the set back."""
        lat = self.lattices
        doc = [] if last else [d for d in active.tolist() if heaps[d]]
        taken = [heapq.heappop(heaps[d]) for d in doc]
        doc, bound = np.array(doc, np.int64), np.array([-t[0] for t in taken])
        parent, cut = (np.array([t[i] for t in taken], np.int64) for i in (1, 2))
        edge, unit, lead = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64), np.zeros(len(doc))
        for i, (d, p, j) in enumerate(zip(doc.tolist(), parent.tolist(), cut.tolist(), strict=True)):
            flat, offset, occ = paths[p]
            a = offset[d]
            edge[i], unit[i], lead[i] = flat[a + j], occ[a + j], lat.logp[flat[a : a + j]].sum()
        place = lat.frm[edge]
        left_out = np.array([len(t[3]) for t in taken], np.int64)
        at = left_out + 64 * (place - lat.first[self.unit[unit]]).astype(np.int64)
        u, v = (uniform(self.seeds[doc], unit - self.unit_begin[doc], at, 40 + i + 2 * min(r, 9)) for i in (0, 1))
        pick, rest = np.zeros(len(doc), np.int64), np.zeros(len(doc))
        for i, (lo, hi) in enumerate(zip(lat.begin[place].tolist(), lat.begin[place + 1].tolist(), strict=True)):
            options = [e for e in range(lo, hi) if e not in taken[i][3]]
            p = np.exp(lat.logp[options])
            one = min(int(np.searchsorted(np.cumsum(p), u[i] * p.sum(), side="right")), len(options) - 1)
            pick[i] = options[one]
            rest[i] = p.sum() - p[one] if len(options) > 1 else 0
        some = np.flatnonzero(rest > 0)
        again = truncated(lead[some] + np.log(rest[some]), bound[some], v[some])
        for i, value in zip(some.tolist(), again.tolist(), strict=True):
            heapq.heappush(heaps[doc[i]], (-value, int(parent[i]), int(cut[i]), (*taken[i][3], int(pick[i]))))
        return doc, bound, lead, cut, parent, pick

    def piece_ids(self, edges: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary ids of edges, bytes written out, and the new offsets."""
        ids = self.lattices.ids[edges]
        wide = np.flatnonzero(ids >= BYTE_EDGE)
        if not len(wide):
            return ids, offset
        code = ids[wide] - BYTE_EDGE
        raw = [(SPACE if c == ord(MARK) else chr(c)).encode() for c in code.tolist()]
        count = np.ones(len(ids), dtype=np.int64)
        count[wide] = [len(x) for x in raw]
        out = np.repeat(ids, count)
        out[np.repeat(ids >= BYTE_EDGE, count)] = self.vocab.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        return out, np.concatenate([[0], np.cumsum(count)])[offset]


NAMES = ["sample", "ids", "log_prob", "perturbed", "log_inclusion"]
KINDS = [pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.float64()]


def log_inclusion(logp: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Log of the chance that a segmentation's perturbed value passes the threshold."""
    x = np.minimum(logp - threshold, 700.0)
    with np.errstate(divide="ignore"):
        return np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.maximum(x, -40.0)))))


def sample_texts(path: str, k: int, batch_chars: int, decode: bool):
    def run(batches):
        store = lattices(path)
        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch["text"]), 0).to_numpy()
            seeds = batch["seed"].to_numpy()
            kept = [c for c in batch.schema.names if c not in ("text", "seed")]
            for lo, hi in slices_by_chars(lengths, batch_chars):
                texts = ["" if t is None else t for t in batch["text"].slice(lo, hi - lo).to_pylist()]
                work = Batch(texts, seeds[lo:hi], store)
                rounds, threshold = work.topk(k)
                for r, (docs, offset, flat, logp, value) in enumerate(rounds):
                    ids, offset = work.piece_ids(flat, offset)
                    raw = ids.astype("<u4").tobytes()
                    packed = [raw[4 * a : 4 * b] for a, b in zip(offset[docs].tolist(), offset[docs + 1].tolist(), strict=True)]
                    columns = [np.full(len(docs), r + 1, np.int32), packed, logp, value, log_inclusion(logp, threshold[docs])]
                    rest = [pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)]
                    if decode:
                        rest.append(pa.array([decoded(store.vocab, b) for b in packed], pa.string()))
                    at = pa.array(docs + lo)
                    yield pa.RecordBatch.from_arrays([*(batch[c].take(at) for c in kept), *rest], [*kept, *NAMES, *["decoded"] * decode])
                work = rounds = packed = rest = texts = None
        release_memory()

    return run


def sample_segmentations(
    docs: DataFrame, model_path: str, k: int = 2, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 1_000_000, decode: bool = False, keep: list[str] | None = None
) -> DataFrame:
    """Up to k distinct segmentations of every text, drawn without replacement, likeliest perturbed first.

    Returns ``id_col, text_crc, sample int, ids binary, log_prob, perturbed,
    log_inclusion``: ``ids`` are piece ids as little-endian unsigned 32-bit integers,
    ``sample`` counts from 1, ``perturbed`` falls with it, ``log_inclusion`` is the log
    of the chance to be among the top k given the threshold (0 where all
    segmentations were drawn), ``text_crc`` the CRC-32 of the text for checking a decode.
    With ``decode`` also ``decoded``, the text of the ids, in the same pass; the
    columns of ``keep`` go along.

    A null text counts as empty; an empty text has one segmentation, of no pieces.
    Rows with the same id draw the same random numbers, so repeated rows repeat their
    samples.  ``batch_chars`` bounds the memory of a task, save for a longer single text.
    An empty table gives an empty result; columns not named are not read.
    """
    text, keep = F.coalesce(F.col(text_col), F.lit("")), keep or []
    rows = docs.select(F.col(id_col).alias("key"), F.crc32(text.cast("binary")).alias("text_crc"), *[F.col(c).alias(f"k_{c}") for c in keep], text.alias("text"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("seed"))
    kept = ", ".join(f"`{n}` {t}" for n, t in rows.drop("text", "seed").dtypes)
    schema = f"{kept}, sample int, ids binary, log_prob double, perturbed double, log_inclusion double" + ", decoded string" * decode
    sampled = rows.mapInArrow(sample_texts(model_path, k, batch_chars, decode), schema)
    return sampled.withColumnsRenamed({"key": id_col} | {f"k_{c}": c for c in keep})


def decoded(vocab: Vocabulary, ids: bytes | None) -> str:
    return vocab.decode(np.frombuffer(ids or b"", dtype="<u4").astype(np.int64)).decode("utf-8", "replace")


def decode_batches(path: str):
    def run(batches):
        vocab = lattices(path).vocab
        for batch in batches:
            texts = [decoded(vocab, b) for b in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def decode_segmentations(samples: DataFrame, model_path: str) -> DataFrame:
    """``samples`` with ``decoded``: the text of ``ids``; null ids decode to an empty text."""
    samples = samples.drop("decoded")
    schema = ", ".join(f"`{n}` {t}" for n, t in samples.dtypes)
    return samples.mapInArrow(decode_batches(model_path), f"{schema}, decoded string")


def segmentation_digests(docs: DataFrame, model_path: str, k: int = 2, keep: list[str] | None = None) -> DataFrame:
    """Samples of every document, decoded again: counts, scores, CRC-32 of the ids, and whether the text came back."""
    samples = sample_segmentations(docs, model_path, k, decode=True, keep=keep)
    back = F.crc32(F.col("decoded").cast("binary")) == F.col("text_crc")
    return samples.select("doc_id", *(keep or []), "sample", (F.length("ids") / 4).cast("long").alias("n_pieces"), "log_prob", "perturbed", "log_inclusion", F.crc32("ids").alias("ids_crc32"), back.alias("decoded_ok"))
