"""Sampled SentencePiece segmentations of whole texts: Gumbel top-k without replacement over the piece lattice.

A piece of merge rank r has the weight 1 / (r + 2) (pieces without a rank count as the last). No piece of the
vocabulary goes on after a word into the white space that follows, so the lattice of a text is the chain of its
words' lattices; each distinct word's lattice is built once for the texts of a batch, with the total weight of all
ways from each place to the word's end.
With these totals the best-first search has an exact bound: the set of all segmentations that begin with some
pieces has a known log probability, and its largest perturbed value is a Gumbel variable at that place, truncated
at the value of the set it is part of.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm import words
from offerlens.llm.tables import give_back, ready

MODEL = "piece_bpe_32k.model"
SAMPLES = 2
SEED = 12
#: Characters of the texts that are searched together, and of the distinct words whose lattices are built together.
PIECE = 1 << 18
PART = 60_000
#: Characters of the words that keep their lattices: those in at least two of CHOSEN_FROM batches, once in CHOSEN_EVERY.
KEPT = 1 << 18
CHOSEN_FROM = 8
CHOSEN_EVERY = 60
SPACE = "▁"
#: Entries of the tables of beginnings of pieces and of pieces; both tables stay in the processor's cache.
_SLOTS = 1 << 20
_PIECE_SLOTS = 1 << 19
_BASE = np.uint64(0xD6E8FEB86659FD93)

_ROWS = "doc_id long, sample int, ids array<int>, n_pieces int, log_prob double, inclusion double, round_trip boolean"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _codes(parts: list[str] | pa.Array) -> np.ndarray:
    """The characters of the parts, each part ended by a zero."""
    if isinstance(parts, pa.Array):
        nothing, zero = (pa.scalar(x, parts.type) for x in ("", "\0"))
        ended = pc.binary_join_element_wise(parts, nothing, zero)  # in one buffer, one behind the other
        joined = ended.buffers()[2].to_pybytes()[: pc.sum(pc.binary_length(ended)).as_py()].decode()
        return np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    return np.frombuffer("\0".join(parts).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", np.uint32)


def _lengths(parts: list[str] | pa.Array) -> np.ndarray:
    if isinstance(parts, pa.Array):
        return pc.utf8_length(parts).to_numpy().astype(np.int64)
    return np.fromiter(map(len, parts), np.int64, len(parts))


def _ranges(codes: np.ndarray, longest: int):
    """For each length, the hash of the characters from each place on."""
    c = codes.astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(c), np.uint64)
    for length in range(1, min(longest, len(c)) + 1):
        total = total[: len(c) - length + 1] * _BASE
        total += c[length - 1 :]
        yield length, _hashed(total)


def _hashed(total: np.ndarray) -> np.ndarray:
    hashed = total * np.uint64(0xBF58476D1CE4E5B9)
    hashed ^= hashed >> np.uint64(32)
    return hashed


class Vocabulary:
    """Pieces with their log weights, read from a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        found: list[tuple[str, int, float]] = []
        self.raw: list[bytes] = []
        self.byte_id = np.zeros(256, np.int32)
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                rank = -model.get_score(i)
                found.append((piece, i, -math.log((rank if 0 <= rank < size else size) + 2)))
                self.raw.append(piece.replace(SPACE, " ").encode())
        self.size = size
        self.byte_weight = -math.log(size + 2)
        self.longest = max(len(p) for p, _, _ in found)
        inner = [p for p, _, _ in found if re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p]
        if inner:
            raise ValueError(f"pieces that cross words: {inner[:3]}")
        lengths = np.array([len(p) for p, _, _ in found])
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        hashes = np.zeros(len(found), np.uint64)
        #: whether a piece may go on after characters of this hash, by its low bits: true for all beginnings of pieces
        self.goes_on = np.zeros(_SLOTS, bool)
        with np.errstate(over="ignore"):
            for length, hashed in _ranges(_codes([p for p, _, _ in found]), self.longest):
                own = np.flatnonzero(lengths == length)
                hashes[own] = hashed[starts[own]]
                self.goes_on[hashed[starts[lengths > length]] & np.uint64(_SLOTS - 1)] = True
        order = np.argsort(hashes)
        #: sorted hashes of the pieces with their ids and weights
        self.hashes = hashes[order]
        self.ids = np.array([i for _, i, _ in found], np.int32)[order]
        self.log_weights = np.array([w for _, _, w in found])[order]
        #: a piece with the given low bits of the hash, -1 if there is none, -2 if there are several
        low = (self.hashes & np.uint64(_PIECE_SLOTS - 1)).astype(np.int64)
        self.slot = np.full(_PIECE_SLOTS, -1, np.int16 if len(low) < 1 << 15 else np.int32)
        self.slot[low] = np.arange(len(low))
        self.slot[np.flatnonzero(np.bincount(low, minlength=_PIECE_SLOTS) > 1)] = -2
        self._raw = pa.array(self.raw, pa.binary())
        self._words = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")

    def words(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct words of the texts, the number of each word in text order, and the count of words of each text.

        A word has the white space before it; line ends stand alone.
        """
        single, spaced = [], {}  # texts of single spaces are cut before each of them, others by the pattern
        for i, text in enumerate(texts):
            if text.startswith(" ") or "  " in text or "\0" in text or SPACE in text:
                spaced[i] = self._words.findall(SPACE + text.replace(" ", SPACE))
                single.append("")
            else:
                single.append(SPACE + text.replace("\n", "\0\n\0").replace(" ", "\0" + SPACE) if text else "")
        cut = pc.split_pattern(pa.array(single, pa.large_string()), "\0")
        flat = cut.flatten()
        real = pc.greater(pc.binary_length(flat), 0)
        flat, owner = flat.filter(real), pc.list_parent_indices(cut).filter(real).to_numpy()
        if spaced:
            flat = pa.concat_arrays([flat, pa.array([w for own in spaced.values() for w in own], pa.large_string())])
            owner = np.concatenate([owner, np.repeat(list(spaced), list(map(len, spaced.values())))])
        numbered = flat.dictionary_encode()
        number = numbered.indices.to_numpy()
        if spaced:
            number = number[np.argsort(owner, kind="stable")]
        return numbered.dictionary, number, np.bincount(owner, minlength=len(texts))

    def find(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the hashes that are pieces, and which pieces they are."""
        at = self.slot[hashed & np.uint64(_PIECE_SLOTS - 1)]
        place = np.flatnonzero(at != -1)
        at = at[place]
        several = np.flatnonzero(at == -2)
        at[several] = np.minimum(np.searchsorted(self.hashes, hashed[place[several]]), len(self.hashes) - 1)
        same = self.hashes[at] == hashed[place]
        return place[same], at[same]

    def decode(self, ids) -> str:
        """The text of a segmentation, without the space that stands before every text."""
        if not len(ids):
            return ""
        taken = self._raw.take(pa.array(ids, pa.int32()))  # in one buffer, one behind the other
        _, ends, data = taken.buffers()
        return str(data[: np.frombuffer(ends, np.int32)[len(ids)]], "utf-8", "replace")[1:]


def _part(v: Vocabulary, codes: np.ndarray, lengths: np.ndarray):
    """The arrays of `Lattices.views` for words of these characters (each ended by a zero) and lengths."""
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    n, most = len(codes), int(lengths.max())
    left = (np.repeat(starts + lengths, lengths + 1) - np.arange(n)).astype(np.int32)
    order = np.argsort(left.astype(np.int16) if most < 32768 else left, kind="stable")
    number = np.empty(n, np.int32)
    number[order] = np.arange(n, dtype=np.int32)
    owns, lengths_, pieces = [], [], []
    # hashes of the characters from the places on where a piece of the length may begin
    chars = codes.astype(np.uint64) + np.uint64(1)
    alive, total = np.flatnonzero(left), np.zeros(n - len(starts), np.uint64)
    odd = alive[:0]
    for length in range(1, min(v.longest, most) + 1):
        if length > 1:
            fits = np.flatnonzero(left[alive] >= length)
            alive, total = alive[fits], total[fits]
        total = total * _BASE + chars[alive + (length - 1)]
        hashed = _hashed(total)
        found, piece = v.find(hashed)
        owns.append(alive[found])
        pieces.append(piece)
        lengths_.append(length)
        if length == 1:
            odd = np.delete(alive, found)
        further = np.flatnonzero(v.goes_on[hashed & np.uint64(_SLOTS - 1)])
        alive, total = alive[further], total[further]
    size = 1 + (codes[odd] >= 0x80) + (codes[odd] >= 0x800) + (codes[odd] >= 0x10000)
    own = np.concatenate([odd, *owns])
    lead = own + np.repeat([1, *lengths_], [len(odd), *map(len, owns)])
    found = np.concatenate(pieces)
    weight = np.concatenate([v.byte_weight * size, v.log_weights[found]])
    piece = np.concatenate([v.size + codes[odd].astype(np.int32), v.ids[found]])
    place = number[own]
    by_place = np.argsort(place.astype(np.uint16) if n <= 65536 else place, kind="stable")  # shorter pieces first
    place, lead, weight, piece = place[by_place], number[lead[by_place]], weight[by_place], piece[by_place]
    begin = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=n))])

    # total weight of all ways from a place to the end of its word
    after, left = (np.repeat(lengths, lengths + 1) - left)[order], left[order]
    total = np.zeros(n)
    bounds = np.searchsorted(left, np.arange(1, most + 2)).tolist()
    for low, high in zip(bounds, bounds[1:]):
        if low < high:
            e0, e1 = begin[low], begin[high]
            ways, seams = weight[e0:e1] + total[lead[e0:e1]], begin[low:high] - e0
            best = np.maximum.reduceat(ways, seams)
            total[low:high] = best + np.log(np.add.reduceat(np.exp(ways - best[place[e0:e1] - low]), seams))
    log = weight + total[lead] - total[place]
    alone = (begin[1:] - begin[:-1] == 1)[place]
    log = np.where(alone, 0.0, np.minimum(log, 0.0))
    sums = np.cumsum(np.exp(log))
    upto = sums - np.concatenate([[0.0], sums])[begin[place]]
    upto[begin[place + 1] - 1] = 2.0  # the last edge takes what rounding leaves
    return number[starts], begin[:-1], upto, np.where(left[lead] == 0, -1, lead), piece, log, after


class Lattices:
    """The lattices of the distinct words of some texts in flat arrays: places, and the edges that leave each place.

    The words go in parts of about `PART` characters, whose arrays stay in the processor's cache while they are
    built. The places of a part are numbered by the characters left in their word, so a place comes after all that it
    leads to. `first` is the first place of a word, `begin` the first edge of a place, `after` the characters of the
    word behind a place. An edge has its share of the probability up to it at its place (`upto`), the place where it
    leads or -1 (`next`), a piece id (from vocabulary size on, a character in bytes), and its log probability at its
    place (`log`).
    """

    def __init__(self, vocabulary: Vocabulary, distinct: list[str] | pa.Array, before: Lattices | None = None):
        """The words are numbered behind those of the lattices `before`, which are taken over."""
        lengths = _lengths(distinct)
        codes, ends = _codes(distinct), np.cumsum(lengths + 1)
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1], PART), side="right"))
        parts = [] if before is None else [(before.first, before.begin[:-1], *before.views()[2:])]
        places, edges = (len(x) for x in parts[0][5:][::-1]) if parts else (0, 0)
        for low, high in zip(cuts, [*cuts[1:], len(distinct)]):
            start = ends[low] - lengths[low] - 1
            first, count, upto, next_, piece, log, after = _part(vocabulary, codes[start : ends[high - 1]], lengths[low:high])
            next_[next_ >= 0] += places
            parts.append((first + places, count + edges, upto, next_, piece, log, after))
            places, edges = places + len(after), edges + len(log)
        self.first, begin, self.upto, self.next, self.piece, self.log, self.after = map(np.concatenate, zip(*parts))
        self.begin = np.append(begin, edges)

    def views(self):
        return self.first, self.begin, self.upto, self.next, self.piece, self.log, self.after


def _uniform(seeds: np.ndarray | np.uint64, at: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the row's seed, the place in its text and the salt only."""
    x = words.mix(seeds + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((salt * 0xD6E8FEB86659FD93) % (1 << 64)))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


_ALL_BITS = (1 << 64) - 1


def _uniform_one(seed: int, at: int, salt: int) -> float:
    """`_uniform` of one row."""
    x = (seed + at * 0x9E3779B97F4A7C15 + salt * 0xD6E8FEB86659FD93) & _ALL_BITS
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL_BITS
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL_BITS
    return (((x ^ (x >> 31)) >> 11) + 0.5) / 2.0**53


def _pick(begin, upto, place: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """For each place the edge whose share of the probability the drawn number falls into."""
    edge = begin[place]
    open_ = np.flatnonzero(upto[edge] <= drawn)
    while len(open_):
        edge[open_] += 1
        open_ = open_[upto[edge[open_]] <= drawn[open_]]
    return edge


def _walk(views, word: np.ndarray, start: np.ndarray, seeds: np.ndarray, salt: int):
    """One segmentation of every word: the edges in text order, the word of each, and its place in the text."""
    first, begin, upto, next_, _, _, after = views
    place, own, steps = first[word], np.arange(len(word)), []
    length = np.zeros(len(word), np.int64)
    while len(own):
        at = start[own] + after[place]
        edge = _pick(begin, upto, place, _uniform(seeds[own], at, salt))
        steps.append((own, edge, at))
        length[own] += 1
        place = next_[edge]
        alive = np.flatnonzero(place >= 0)
        own, place = own[alive], place[alive]
    ends = np.cumsum(length)
    begins, edges, ats = ends - length, np.empty(ends[-1], np.int64), np.empty(ends[-1], np.int64)
    for t, (own, edge, at) in enumerate(steps):
        to = begins[own] + t
        edges[to], ats[to] = edge, at
    return edges, np.repeat(np.arange(len(word)), length), ats


def _truncated(log_mass: np.ndarray, bound: float, drawn: np.ndarray) -> np.ndarray:
    """Gumbel variables at the log masses, given that they lie below the bound."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return log_mass - np.log(np.exp(log_mass - bound) - np.log(drawn))


#: -log of the least distance of a drawn number from 1, with a margin: no perturbed value lies further above its mass.
_REACH = 38.0


class _Path:
    """A segmentation and the sets that leave it: at step t, all that share its first t pieces but not the next.

    Their perturbed values are worked out as far as they can be the largest. `limit` is what no later one exceeds;
    `extend` works out the rest.
    """

    def __init__(self, edges, owners, at, value, views, seed, salt, since=0):
        self.edges, self.owners, self.at, self.value, self.since = edges, owners, at, value, since
        self.logs, self.seed, self.salt = views[5][edges], seed, salt
        sums = np.cumsum(self.logs)
        self.before, self.log = sums - self.logs, float(sums[-1])
        self.taken: dict[int, list[int]] = {}
        self.bounds = np.full(len(edges), -np.inf)
        # log masses only fall from step to step; the largest perturbed value is seldom far below this path's
        near = len(edges) - int(np.searchsorted(self.before[::-1], value - 1.25 * _REACH))
        self._work_out(since, max(near, since))

    def _work_out(self, start: int, stop: int) -> None:
        logs = self.logs[start:stop]
        # of an edge that takes nearly everything, the rest is what the other edges have
        rest = np.log(np.maximum(-np.expm1(logs), 0), where=logs < 0, out=np.full(len(logs), -np.inf))
        drawn = _uniform(self.seed, self.at[start:stop], self.salt)
        self.bounds[start:stop] = _truncated(self.before[start:stop] + rest, self.value, drawn)
        self.done = stop
        self.limit = float(self.before[stop]) + _REACH if stop < len(self.edges) else -math.inf

    def extend(self) -> None:
        if self.done < len(self.edges):
            self._work_out(self.done, len(self.edges))


def search(views, walks, seed: np.uint64, samples: int) -> tuple[list[_Path], float]:
    """The segmentations with the largest perturbed values, best first, and the value of the next one."""
    value = -math.log(-math.log(_uniform_one(int(seed), 0, 901)))
    paths = [_Path(*walks[0], value, views, seed, 902)]
    while True:
        best, step, bound = None, -1, -math.inf
        for path in paths:
            t = int(path.bounds.argmax())
            if path.bounds[t] > bound:
                best, step, bound = path, t, float(path.bounds[t])
        if bound < max(path.limit for path in paths):
            for path in paths:
                path.extend()
            continue
        if len(paths) == samples or best is None:
            return paths, bound
        number = len(paths)
        paths.append(_branch(views, best, step, bound, walks[number], seed, 910 + 10 * number))


def _branch(views, path: _Path, step: int, bound: float, fresh, seed: np.uint64, salt: int) -> _Path:
    """The best segmentation of the set that leaves `path` at `step`, and what remains of that set."""
    _, begin, upto, next_, _, log, after = views
    edge, at, one = int(path.edges[step]), int(path.at[step]), int(seed)
    place = int(np.searchsorted(begin, edge, side="right")) - 1
    others = [e for e in range(int(begin[place]), int(begin[place + 1])) if e != edge and e not in path.taken.get(step, ())]
    shares = np.exp(log[others])
    drawn = _uniform_one(one, at, salt) * shares.sum()
    chosen = others[min(int(np.searchsorted(np.cumsum(shares), drawn, side="right")), len(others) - 1)]
    path.taken.setdefault(step, []).append(chosen)
    left = float(shares.sum() - math.exp(log[chosen])) if len(others) > 1 else 0.0
    mass = np.array([path.before[step] + math.log(left)]) if left > 0 else np.array([-np.inf])
    path.bounds[step] = _truncated(mass, bound, np.array([_uniform_one(one, at, salt + 1)]))[0]
    tail, places, owner = [chosen], [at], int(path.owners[step])
    while (spot := int(next_[tail[-1]])) >= 0:
        places.append(at + int(after[spot] - after[place]))
        drawn, taken = _uniform_one(one, places[-1], salt + 2), int(begin[spot])
        while upto[taken] <= drawn:
            taken += 1
        tail.append(taken)
    later = int(np.searchsorted(fresh[1], owner, side="right"))
    edges = np.concatenate([path.edges[:step], tail, fresh[0][later:]])
    owners = np.concatenate([path.owners[:step], np.full(len(tail), owner), fresh[1][later:]])
    at_all = np.concatenate([path.at[:step], places, fresh[2][later:]])
    return _Path(edges, owners, at_all, bound, views, seed, salt + 3, since=step + 1)


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Sampler:
    """Distinct sampled segmentations of the texts of a task."""

    def __init__(self, path: str):
        self.vocabulary = _vocabulary(path)
        self._batches, self._seen, self._kept, self._kept_words = 0, [], None, None

    def _lattices(self, distinct: pa.Array) -> tuple[Lattices, np.ndarray]:
        """Lattices that hold the words, and the number of each word there.

        Words that several batches hold keep their lattices: a bounded number of words is chosen anew from time to time.
        """
        if self._kept is None:
            found, number = Lattices(self.vocabulary, distinct), np.arange(len(distinct))
        else:
            at = pc.index_in(distinct, value_set=self._kept_words)
            new = distinct.filter(pc.is_null(at))
            found = Lattices(self.vocabulary, new, self._kept) if len(new) else self._kept
            number = pc.fill_null(at, -1).to_numpy().astype(np.int64)
            number[number < 0] = len(self._kept_words) + np.arange(len(new))
        turn, self._batches = self._batches % CHOSEN_EVERY, self._batches + 1
        if turn < CHOSEN_FROM:
            self._seen.append(distinct)
        if turn == CHOSEN_FROM - 1:
            words_, times = pa.concat_arrays(self._seen).value_counts().flatten()
            often = np.argsort(-times.to_numpy(), kind="stable")[: int((times.to_numpy() > 1).sum())]
            often = often[np.cumsum(_lengths(words_)[often] + 1) <= KEPT]
            self._seen, self._kept_words = [], words_.take(pa.array(often))
            self._kept = Lattices(self.vocabulary, self._kept_words) if len(often) else None
        return found, number

    def _ids(self, pieces: np.ndarray) -> np.ndarray:
        """Piece ids, with characters that are no piece as their bytes."""
        v = self.vocabulary
        odd = np.flatnonzero(pieces >= v.size)
        if not len(odd):
            return pieces.astype(np.int32)
        if (pieces[odd] < v.size + 0x80).all():
            out = pieces.astype(np.int32)
            out[odd] = v.byte_id[pieces[odd] - v.size]
            return out
        spelled = [[p] if p < v.size else v.byte_id[list(chr(p - v.size).encode("utf-8", "surrogatepass"))] for p in pieces.tolist()]
        return np.concatenate(spelled).astype(np.int32)

    def sample(self, texts: list[str], keys: list[int], samples: int) -> list[list[tuple[np.ndarray, float, float]]]:
        """For each text its (ids, log probability, inclusion probability), best first."""
        distinct, word, counts = self.vocabulary.words(texts)
        drawn = words.mix(np.array([k & (2**64 - 1) for k in keys], np.uint64) + np.uint64(SEED))
        if not len(distinct):
            return [[(np.empty(0, np.int32), 0.0, 1.0)] for _ in texts]
        lengths = _lengths(distinct)
        lattices, number = self._lattices(distinct)
        views = lattices.views()
        ends = np.cumsum(lengths[word])
        text_of = np.repeat(np.arange(len(texts)), counts)
        text_start = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)[:-1]])]
        flat = number[word], ends - lengths[word] - text_start[text_of], drawn[text_of]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        walks = [_walk(views, *flat, salt) for salt in range(samples)]
        cuts = [np.searchsorted(w[1], bounds) for w in walks]
        found = []
        for i, n in enumerate(counts):
            if not n:
                found.append([(np.empty(0, np.int32), 0.0, 1.0)])
                continue
            own = [tuple(x[c[i] : c[i + 1]] for x in w) for w, c in zip(walks, cuts)]
            paths, limit = search(views, own, drawn[i], samples)
            rows = []
            for path in paths:
                inclusion = 1.0 if limit == -math.inf else -math.expm1(-math.exp(min(path.log - limit, 700)))
                rows.append((self._ids(views[4][path.edges]), path.log, inclusion))
            found.append(rows)
        return found


def _rows(path: str, samples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from _sampled(batches, Sampler(path), samples)
        finally:  # lattices end with the task, else idle workers hold them through all later stages
            give_back()

    return run


def _sampled(batches: Iterator[pa.RecordBatch], sampler: Sampler, samples: int) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t if t is not None else "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) <= PIECE:
                    size += len(texts[end])
                    end += 1
                found = sampler.sample(texts[at:end], [k or 0 for k in ids[at:end]], samples)
                yield _table(sampler.vocabulary, ids[at:end], texts[at:end], found)
                at = end


def _table(vocabulary: Vocabulary, ids: list[int | None], texts: list[str], found: list) -> pa.RecordBatch:
    """The rows of the found segmentations; all piece ids lie in one array."""
    keys, numbers, pieces, logs, inclusions, same = [], [], [], [], [], []
    for key, text, rows in zip(ids, texts, found):
        plain = text.replace(SPACE, " ")
        for number, (own, log, inclusion) in enumerate(rows):
            keys.append(key)
            numbers.append(number)
            pieces.append(own)
            logs.append(log)
            inclusions.append(inclusion)
            same.append(vocabulary.decode(own) == plain)
    counts = np.fromiter(map(len, pieces), np.int32, len(pieces))
    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), np.concatenate(pieces))
    columns = [pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), lists, pa.array(counts)]
    columns += [pa.array(logs, pa.float64()), pa.array(inclusions, pa.float64()), pa.array(same, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _ROWS.split(", ")])


def segmentations(
    documents: DataFrame, samples: int = SAMPLES, path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Up to `samples` distinct segmentations of each whole text, best perturbed value first.

    Columns: `doc_id, sample, ids, n_pieces, log_prob, inclusion, round_trip`. `inclusion` is the probability that a
    segmentation of this log probability is among the sample, given the value of the next one (1 where no
    other exists). `round_trip`: the ids decode to the text (U+2581 decodes to a space). The draws depend on the id
    and the text only; a null id draws as 0.

    A null or empty text has one segmentation, without pieces; a text with fewer segmentations than asked for gives
    them all. Characters that are no piece are given as bytes. Repeated rows get the same rows again.
    """
    source = ready(documents).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_rows(path or model_path(), samples), _ROWS)
