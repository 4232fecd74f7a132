"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's lattice has a node for each character and an edge for each vocabulary piece that fits. It is cut only where no
piece reaches over: before a run of spaces and around a line end (if the vocabulary has no piece across these), and inside
units of more than 32 bytes where none that fits goes on. So it is a chain of mostly small units, and each distinct unit
of a run of texts is built once: edges by hashed look-up, the log mass of all ways to the end by a backward pass.

The k segmentations are the k largest of Gumbel-perturbed log probabilities over all segmentations. They are found by
A* search from the top down: the root holds the maximum of all; along the best path each step leaves a frontier node,
the other ways from there, whose own maximum is a Gumbel with their mass, truncated at the maximum above. The largest
frontier node is opened next, so exactly the k best come out, distinct and in order, and the next one (the threshold)
gives each its inclusion score 1 - exp(-exp(logp - threshold)); 1 if there are no more segmentations. Random numbers
are hashes of seed, row key, sample, unit and step: a row's samples depend on nothing else.

The vocabulary's BPE scores are ranks, not probabilities; a piece's probability here is proportional to
1 / (rank + 10). A character without a piece falls back to its bytes, each with probability 1e-6.

The row key is doc_id; rows with one doc_id share random numbers, and a null doc_id uses the key 0. A null or empty
text has one segmentation without pieces (logp 0). A literal U+2581 decodes to a space, as with the library.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.common import Substrings, documents, freeing, mix, ranges, text_chunks, uniform

SPACE = "▁".encode()
RUN = 32
SHARED = -2
BYTE_P = 1e-6


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        rank = {i: r for r, i in enumerate(sorted(normal, key=lambda i: (-sp.get_score(i), i)))}
        total = sum(1 / (r + 10) for r in rank.values())
        pieces = {i: sp.id_to_piece(i).encode() for i in normal}
        usable = [i for i in normal if pieces[i]]
        self.over_space = any(SPACE in re.sub(b"^(?:%s)+" % SPACE, b"", x) for x in pieces.values())
        self.over_line = any(b"\n" in x and len(x) > 1 for x in pieces.values())
        ids, raw = np.array(usable), [pieces[i] for i in usable]
        ends = np.cumsum([len(x) for x in raw])
        starts = ends - np.array([len(x) for x in raw])
        h = Substrings(np.frombuffer(b"".join(raw), np.uint8)).hash(starts, ends)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], ids[order].astype(np.int64)
        self.log_p = np.log(np.array([1 / (rank[i] + 10) / total for i in usable])[order])
        self.longest = int((ends - starts).max())
        # a piece's number by 22 bits of its hash; SHARED where several have the same
        place = (self.hashes >> np.uint64(42)).astype(np.int64)
        self.number = np.full(1 << 22, -1, np.int32)
        self.number[place] = np.arange(place.size)
        self.number[place[1:][place[1:] == place[:-1]]] = SHARED
        # beginnings of pieces, so that a search stops where no piece goes on
        self.begin_bits = np.zeros(1 << 22, bool)
        every = np.frombuffer(b"".join(raw), np.uint8)
        subs = Substrings(every)
        for m in range(1, self.longest + 1):
            at = starts[starts + m <= ends]
            self.begin_bits[(subs.hash(at, at + m) >> np.uint64(42)).astype(np.int64)] = True
        # pieces of one and of two bytes, and pairs of bytes with which longer ones begin, without hashing
        self.one, self.two, self.begins = np.full(256, -1, np.int32), np.full(1 << 16, -1, np.int32), np.zeros(1 << 16, bool)
        place = np.argsort(order)
        for i, x in enumerate(raw):
            if len(x) == 1:
                self.one[x[0]] = place[i]
            else:
                self.begins[x[0] << 8 | x[1]] = True
                if len(x) == 2:
                    self.two[x[0] << 8 | x[1]] = place[i]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        out = [pieces.get(i, b"") for i in range(n)]
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.out_size = np.array([len(x) for x in out])
        self.out_start = np.cumsum(self.out_size) - self.out_size

    def matches(self, data: np.ndarray, at: np.ndarray, rem: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By length: (bytes, places among `at` where a piece of so many bytes fits, its number); rem: bytes left from each byte on."""
        k = self.one[data[at]]
        yield 1, at[k >= 0], k[k >= 0]
        at = at[rem[at] >= 2]
        pair = data[at].astype(np.int32) << 8 | data[at + 1]
        k = self.two[pair]
        yield 2, at[k >= 0], k[k >= 0]
        at, subs = at[self.begins[pair]], Substrings(data)
        for n in range(3, self.longest + 1):
            at = at[rem[at] >= n]
            h = subs.hash(at, at + n)
            place = (h >> np.uint64(42)).astype(np.int64)
            alive = self.begin_bits[place]
            at, h, place = at[alive], h[alive], place[alive]
            if not at.size:
                break
            k = self.number[place]
            shared = np.flatnonzero(k == SHARED)
            k[shared] = np.minimum(np.searchsorted(self.hashes, h[shared]), self.hashes.size - 1)
            hit = np.flatnonzero(k >= 0)
            hit = hit[self.hashes[k[hit]] == h[hit]]
            yield n, at[hit], k[hit]

    def decode(self, ids: np.ndarray) -> bytes:
        raw = self.out_bytes[ranges(self.out_start[ids], self.out_size[ids])].tobytes().replace(SPACE, b" ")
        return raw[1:] if raw[:1] == b" " else raw


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def units(data: np.ndarray, offsets: np.ndarray, v: Vocabulary | None = None) -> np.ndarray:
    """Starts of the lattice's units in texts whose spaces are already signs; with the end of all at the end.

    With a vocabulary no piece that fits spans a cut; without one, units end at spaces, line ends and each RUN bytes.
    """
    start = np.zeros(data.size + 1, bool)
    start[offsets] = True
    if v is None or not v.over_space:
        sign = np.flatnonzero(data == SPACE[0])
        sign = sign[sign + 2 < data.size]
        sign = sign[(data[sign + 1] == SPACE[1]) & (data[sign + 2] == SPACE[2])]
        # a run of spaces stays together, but not over the start of a text
        start[sign if v is None else sign[np.diff(sign, prepend=-9) != 3]] = True
    if v is None or not v.over_line:
        line = np.flatnonzero(data == 10)
        start[line] = True
        start[line + 1] = True
    at = np.flatnonzero(start)
    size = np.diff(at)
    long = np.flatnonzero(size > RUN)
    if long.size and v is not None:
        place = ranges(at[long], size[long])
        part, ends = data[place], np.cumsum(size[long])
        head = part & 0xC0 != 0x80
        turns = np.zeros(part.size + 1, np.int64)  # of pieces: one more that has begun before this byte, one that has ended
        for n, a, _ in v.matches(part, np.flatnonzero(head), np.repeat(ends, size[long]) - np.arange(part.size)):
            turns[a + 1] += 1
            turns[a + n] -= 1
        start[place[head & (np.cumsum(turns)[:-1] == 0)]] = True
        at = np.flatnonzero(start)
    elif long.size:
        more = (size[long] - 1) // RUN
        cut = np.repeat(at[long], more) + RUN * (ranges(np.zeros(long.size, np.int64), more) + 1)
        for _ in range(3):  # to the start of a character
            cut = np.where((cut < data.size) & (data[np.minimum(cut, data.size - 1)] & 0xC0 == 0x80), cut + 1, cut)
        start[cut] = True
        at = np.flatnonzero(start)
    return at


class Lattice:
    """Edges of distinct units: from state to state, piece (below zero: minus the number of bytes), chance."""

    def __init__(self, v: Vocabulary, data: np.ndarray, first: np.ndarray):
        size = np.diff(first)
        unit = np.repeat(np.arange(size.size), size)
        pos = np.arange(data.size)
        rem = first[1:][unit] - pos
        head = data & 0xC0 != 0x80
        frm, to, piece, p = [], [], [], []
        single = np.zeros(data.size, bool)
        width = np.where(data >= 0xF0, 4, np.where(data >= 0xE0, 3, np.where(data >= 0xC0, 2, 1)))
        for n, a, k in v.matches(data, pos[head], rem):
            frm.append(a)
            to.append(a + n)
            piece.append(v.ids[k])
            p.append(v.log_p[k])
            single[a[width[a] == n]] = True
        bare = np.flatnonzero(head & ~single)
        n = np.minimum(width[bare], rem[bare])
        frm.append(bare)
        to.append(bare + n)
        piece.append(-n)
        p.append(n * np.log(BYTE_P))
        # states: one for each byte position, and one more at the end of each unit
        state = pos + unit
        n_states = data.size + size.size
        self.end = np.zeros(n_states, bool)
        self.end[first[1:] + np.arange(size.size)] = True
        self.start = first[:-1] + np.arange(size.size)
        # edges by state, longest first; a batch above has a state once at most, so places need no sort
        degree = np.zeros(n_states, np.int64)
        for a in frm:
            degree[state[a]] += 1
        self.first = np.concatenate([[0], np.cumsum(degree)])
        n_edges = int(self.first[-1])
        self.to, self.piece, self.at, self.frm = (np.empty(n_edges, np.int32) for _ in range(4))
        chance = np.empty(n_edges)
        while frm:
            a, t, i, x = frm.pop(0), to.pop(0), piece.pop(0), p.pop(0)
            own = state[a]
            degree[own] -= 1
            slot = self.first[own] + degree[own]
            self.to[slot], self.piece[slot], self.at[slot], self.frm[slot], chance[slot] = t + unit[a], i, a, own, x
        s = self.frm
        # logs, since the mass of a long unit is too small for a double; a depth's edges are in order of state
        mass = np.where(self.end, 0.0, -np.inf)
        depth = self.at - first[:-1][unit[self.at]]
        depth = depth.astype(np.uint8 if size.max(initial=0) < 256 else np.uint16 if size.max() < 65_536 else np.int64)
        order = np.argsort(depth, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(depth, minlength=1))])
        for d in range(len(cuts) - 2, -1, -1):
            e = order[cuts[d] : cuts[d + 1]]
            if e.size:
                own = s[e]
                begin = np.flatnonzero(np.diff(own, prepend=-1))
                w = chance[e] + mass[self.to[e]]
                top = np.maximum.reduceat(w, begin)
                w = np.exp(w - np.repeat(top, np.diff(begin, append=e.size)))
                mass[own[begin]] = top + np.log(np.add.reduceat(w, begin))
        self.log_q = chance + mass[self.to] - mass[s]
        self.q = np.exp(self.log_q)
        total = np.cumsum(self.q)
        self.cum = total - np.concatenate([[0.0], total])[self.first[s]]
        self.only = np.diff(self.first)[s] == 1

    def draw(self, state: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a random way to the end from each state, one after the other, and the number of each."""
        steps, live, n = [], np.arange(state.size, dtype=np.int32), np.zeros(state.size, np.int64)
        state, key, step = state.copy(), key.copy(), 0
        live = live[~self.end[state]]
        while live.size:
            s = state[live]
            r = uniform(mix(key[live] + _salt(step, 0xD6E8FEB86659FD93)))
            e, last = self.first[s].copy(), self.first[s + 1] - 1
            more = np.flatnonzero((r > self.cum[e]) & (e < last))
            while more.size:
                e[more] += 1
                more = more[(r[more] > self.cum[e[more]]) & (e[more] < last[more])]
            steps.append((live, e.astype(np.int32)))
            n[live] += 1
            state[live] = self.to[e]
            live = live[~self.end[state[live]]]
            step += 1
        out, at = np.zeros(int(n.sum()), np.int32), np.cumsum(n) - n
        for t, (own, e) in enumerate(steps):
            out[at[own] + t] = e
        return out, n


def _salt(i: int, by: int) -> np.uint64:
    return np.uint64((i + 1) * by % (1 << 64))


def _truncated(phi: np.ndarray, bound: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Gumbels with location phi, given that they are below bound."""
    return -np.logaddexp(-bound, np.log(-np.log(uniform(mix(key)))) - phi)


class Path:
    __slots__ = ("edges", "frontier", "logp", "taken", "value")

    def __init__(self, edges, logp, frontier, value, taken):
        self.edges, self.logp, self.frontier, self.value, self.taken = edges, logp, frontier, value, taken


def sample(lat: Lattice, unit: np.ndarray, first: np.ndarray, key: np.ndarray, k: int) -> tuple[list[list[Path]], np.ndarray]:
    """The k (or all) best perturbed segmentations of each text, and the value of the next one (-inf if there is none);
    unit: its units' numbers, first: where texts start."""
    n_docs = first.size - 1
    out: list[list[Path]] = [[] for _ in range(n_docs)]
    following = np.full(n_docs, -np.inf)
    sizes = np.diff(first)
    ordinal = np.arange(unit.size) - np.repeat(first[:-1], sizes)
    doc_of_unit = np.repeat(np.arange(n_docs), sizes)
    root = -np.log(-np.log(uniform(mix(key + np.uint64(77)))))
    # for each text: the unit and state from which the next path is drawn, what stands before, the value above
    jobs = [(d, 0, -1, None) for d in range(n_docs) if sizes[d]]
    values = dict(enumerate(root.tolist()))
    for d in range(n_docs):
        if not sizes[d]:
            out[d].append(Path(np.zeros(0, np.int64), 0.0, np.zeros(0), float(root[d]), {}))
    for s in range(k):
        if not jobs:
            break
        d = np.array([j[0] for j in jobs])
        begin = first[d] + np.array([j[1] for j in jobs])
        count = first[d + 1] - begin
        u = ranges(begin, count)
        state = lat.start[unit[u]]
        heads = np.cumsum(count) - count
        forced = np.array([j[2] for j in jobs])
        has = np.flatnonzero(forced >= 0)
        state[heads[has]] = lat.to[forced[has]]
        salt = mix(key[doc_of_unit[u]] + _salt(s, 0xA0761D6478BD642F))
        edges, n = lat.draw(state, mix(salt + ordinal[u].astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)))
        total = np.concatenate([[0], np.cumsum(n)])
        lo, hi = total[heads], total[heads + count]
        # the path of each text: what is kept of its parent, the forced edge, what was drawn
        parts = []
        for i, (doc, _, f, parent) in enumerate(jobs):
            own = edges[lo[i] : hi[i]]
            parts.append(own if parent is None else np.concatenate([parent[0].edges[: parent[1]], [f], own]))
        length = np.array([len(p) for p in parts])
        flat, ends = np.concatenate(parts), np.cumsum(length)
        begins = ends - length
        lq = lat.log_q[flat]
        run = np.concatenate([[0.0], np.cumsum(lq)])
        prefix = run[:-1] - np.repeat(run[begins], length)
        logp = run[ends] - run[begins]
        rest = np.where(lat.only[flat], 0.0, np.maximum(1 - lat.q[flat], 1e-300))
        turn = np.zeros(len(jobs), np.int64)
        for i, (doc, _, f, parent) in enumerate(jobs):
            if parent is not None:  # at the forced edge, the ways its parents took are gone too
                t, left = parent[1], parent[2]
                turn[i] = t
                rest[begins[i] + t] = left
        bound = np.array([values[j[0]] for j in jobs])
        step = np.arange(flat.size) - np.repeat(begins, length)
        # frontier nodes: the steps from the turn on that have other ways left; what is before belongs to the parents
        job = np.repeat(np.arange(len(jobs)), length)
        new = np.flatnonzero((step >= turn[job]) & (rest > 0))
        own = job[new]
        phi = prefix[new] + np.log(rest[new])
        g = np.full(flat.size, -np.inf)
        g[new] = _truncated(phi, bound[own], mix(key[d] + _salt(s, 0x8EBC6AF09C88C6E3))[own] + step[new].astype(np.uint64))
        for i, (doc, _, f, parent) in enumerate(jobs):
            a, b = begins[i], ends[i]
            taken = {} if parent is None else {parent[1]: parent[3]}
            out[doc].append(Path(flat[a:b], float(logp[i]), g[a:b], float(bound[i]), taken))
        # open the largest frontier node of each text; after the last path its value alone is wanted
        jobs = []
        for doc in d.tolist():
            best, path, t = -np.inf, None, -1
            for p in out[doc]:
                at = int(p.frontier.argmax())
                if p.frontier[at] > best:
                    best, path, t = float(p.frontier[at]), p, at
            if s == k - 1 or path is None:
                following[doc] = best
                continue
            path.frontier[t] = -np.inf
            e = int(path.edges[t])
            gone = path.taken.get(t, ()) + (e,)
            here = int(lat.frm[e])
            ways = np.array([x for x in range(int(lat.first[here]), int(lat.first[here + 1])) if x not in gone])
            share = lat.q[ways]
            r = float(uniform(mix(key[doc : doc + 1] + _salt(s, 0x589965CC75374CC3) + np.uint64(t)))[0])
            f = int(ways[min(int(np.searchsorted(np.cumsum(share), r * share.sum())), ways.size - 1)])
            left = float(share.sum() - lat.q[f]) if ways.size > 1 else 0.0
            values[doc] = best
            u_at = int(lat.end[lat.to[path.edges[:t]]].sum())  # units ended before step t
            jobs.append((doc, u_at, f, (path, t, max(left, 0.0), gone)))
    return out, following


FIELDS = {"rank": pa.int32(), "n_pieces": pa.int32(), "ids_crc32": pa.int64(), "logp": pa.float64(), "perturbed": pa.float64(), "inclusion": pa.float64(), "decoded": pa.bool_()}
SAMPLES = "array<struct<rank:int,n_pieces:int,ids_crc32:long,logp:double,perturbed:double,inclusion:double,decoded:boolean{ids}>>"


def encode(docs: DataFrame, path: str, k: int = 3, seed: int = 1, ids: str | None = "array", run_bytes: int = 1 << 20) -> DataFrame:
    """doc_id and samples: the k best perturbed segmentations in order, with ids as an `array`, `packed` as
    little-endian 32-bit integers in a binary (cheaper to write), or None.

    decoded says that decoding the ids gives the text back. `run_bytes` of text are worked on at a time, which bounds the
    memory of a task and changes nothing else.
    """

    def one(v: Vocabulary, batch: pa.RecordBatch, lo: int, hi: int, offsets: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        keys = mix(batch.column("doc_id").slice(lo, hi - lo).fill_null(0).to_numpy().astype(np.uint64) + np.uint64(seed * 1_000_003 % (1 << 64)))
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        signed = [SPACE + t.replace(b" ", SPACE) if t else b"" for t in texts]
        at = np.concatenate([[0], np.cumsum([len(t) for t in signed])])
        body = np.frombuffer(b"".join(signed), np.uint8)
        lat, pieces = None, body
        if body.size:
            cuts = units(body, at, v)
            flat = pa.Array.from_buffers(pa.large_binary(), cuts.size - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(body)]).dictionary_encode()
            inner = np.frombuffer(flat.dictionary.buffers()[1], np.int64)[: len(flat.dictionary) + 1]
            pieces = np.frombuffer(flat.dictionary.buffers()[2], np.uint8)[: inner[-1]]
            lat = Lattice(v, pieces, inner)
            found, following = sample(lat, flat.indices.to_numpy(zero_copy_only=False), np.searchsorted(cuts, at), keys, k)
        else:
            found, following = sample_empty(keys, hi - lo), np.full(hi - lo, -np.inf)
        # by rank over all texts of the run; then rows in order of (text, rank)
        rows_at, parts, crc, whole, logp, value, size = [], [], [], [], [], [], []
        for r in range(k):
            docs_ = [i for i, paths in enumerate(found) if len(paths) > r]
            edges = [found[i][r].edges for i in docs_]
            got, n = _ids(v, lat, pieces, edges)
            raw_ids, ends = memoryview(got.astype("<u4").tobytes()), np.cumsum(n)
            # the ids' bytes against the texts; text by text only where they differ somewhere
            back = v.out_bytes[ranges(v.out_start[got], v.out_size[got])].tobytes()
            same = back == b"".join([signed[i] for i in docs_])
            for j, i in enumerate(docs_):
                own = raw_ids[4 * int(ends[j] - n[j]) : 4 * int(ends[j])]
                crc.append(zlib.crc32(own))
                whole.append(same or v.decode(np.frombuffer(own, "<u4").astype(np.int64)) == texts[i].replace(SPACE, b" "))
                logp.append(found[i][r].logp)
                value.append(found[i][r].value)
            rows_at += [i * k + r for i in docs_]
            size.append(n)
            parts.append(got)
        order = np.argsort(rows_at, kind="stable")
        size = np.concatenate(size)
        logp, ranks = np.array(logp)[order], np.array(rows_at)[order] % k
        gap = np.minimum(logp - following[np.array(rows_at)[order] // k], 700.0)
        out = {
            "rank": ranks, "n_pieces": size[order], "ids_crc32": np.array(crc)[order], "logp": logp, "perturbed": np.array(value)[order], "inclusion": -np.expm1(-np.exp(gap)), "decoded": np.array(whole, bool)[order],
        }
        cols = {f: pa.array(x, FIELDS[f]) for f, x in out.items()}
        if ids:
            begins = (np.cumsum(size) - size)[order]
            ends = np.concatenate([[0], np.cumsum(out["n_pieces"])]).astype(np.int32)
            flat = np.concatenate(parts).astype("<i4")[ranges(begins, out["n_pieces"])]
            if ids == "array":
                cols["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            else:
                cols["ids"] = pa.Array.from_buffers(pa.binary(), ends.size - 1, [None, pa.py_buffer(ends * np.int32(4)), pa.py_buffer(flat)])
        rows = pa.StructArray.from_arrays(list(cols.values()), list(cols))
        ends = np.concatenate([[0], np.cumsum([min(len(paths), k) for paths in found])]).astype(np.int32)
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "samples": pa.ListArray.from_arrays(pa.array(ends), rows)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for part in text_chunks(batch, most=run_bytes):
                yield one(v, batch, *part)  # what a run needs is given back before the next one begins

    return documents(docs).mapInArrow(freeing(run), f"doc_id long, samples {SAMPLES.format(ids={"array": ",ids:array<int>", "packed": ",ids:binary", None: ""}[ids])}")


def sample_empty(keys: np.ndarray, n: int) -> list[list[Path]]:
    none = np.zeros(0)
    root = -np.log(-np.log(uniform(mix(keys + np.uint64(77)))))
    return [[Path(np.zeros(0, np.int64), 0.0, none, float(root[d]), {})] for d in range(n)]


def _ids(v: Vocabulary, lat: Lattice | None, data: np.ndarray, paths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of paths one after the other, and the number of each; a character without a piece becomes its bytes."""
    count = np.array([len(p) for p in paths], np.int64)
    if not count.sum():
        return np.zeros(0, np.int64), count
    edges = np.concatenate(paths)
    piece = lat.piece[edges].astype(np.int64)
    bare = piece < 0
    if not bare.any():
        return piece, count
    n = np.where(bare, -piece, 1)
    out = np.repeat(piece, n)
    low = np.repeat(bare, n)
    out[low] = v.byte_ids[data[ranges(lat.at[edges[bare]].astype(np.int64), n[bare])]]
    total = np.concatenate([[0], np.cumsum(n)])
    ends = np.cumsum(count)
    return out, total[ends] - total[ends - count]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, rank, text of each sample of encode(), with ids of either form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            got = [v.decode(np.frombuffer(x, "<i4").astype(np.int64) if isinstance(x, bytes) else np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "rank": batch.column("rank"), "text": pa.array(got, pa.string())})

    rows = encoded.select("doc_id", F.explode("samples").alias("s")).select("doc_id", F.col("s.rank").alias("rank"), F.col("s.ids").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, rank int, text string")
