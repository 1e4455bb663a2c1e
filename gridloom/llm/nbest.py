"""N-best segmentation over a SentencePiece vocabulary, and decoding.

Forward Viterbi gives the best score from the start to each position of the piece lattice. Backward
A* from the end adds these scores to what a partial path has already: the heuristic is exact, so
complete paths come out best first. Two characters that are neighbours in no piece always part, so
the lattice falls into parts that are searched on their own and remembered.
"""

from __future__ import annotations

import gc
import re
from array import array
from heapq import heappop, heappush
from itertools import combinations, groupby
from operator import itemgetter

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_text, text_groups

MARK = "▁"
NBEST = 3
#: Words of one generation that a worker remembers, about 300 bytes each; it keeps two generations.
REMEMBERED = 200_000
#: What a character outside the vocabulary costs beyond the worst piece.
UNKNOWN = 10.0
_NEVER = float("inf")
_total = itemgetter(0)

#: A segmentation: score and ids as little-endian unsigned 32-bit integers.
Found = tuple[float, bytes]
#: What is remembered of a word or part: its best score and ids, and by how much the second best is worse.
Best = tuple[float, bytes, float]


class Segmenter:
    def __init__(self, path: str, n: int = NBEST):
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n, self.text_of, self.bytes, pieces = n, [], {}, {}
        for i in range(p.get_piece_size()):
            piece = p.id_to_piece(i)
            raw = b""
            if p.is_byte(i):
                raw = bytes([int(piece[3:5], 16)])
                self.bytes[raw[0]] = i
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                raw = piece.replace(MARK, " ").encode()
                pieces[piece] = (p.get_score(i), i.to_bytes(4, "little"))
            self.text_of.append(raw)
        self.unk = p.unk_id()
        self.worst = min((x for x, _ in pieces.values()), default=0.0) - UNKNOWN
        #: a tree of the pieces' characters: character -> (score and ids of the piece that ends here or None, what follows or None)
        self.tree = self._tree(sorted(pieces.items()), 0) or {}
        self.longest = max(map(len, pieces), default=1)
        self.joined = {piece[k : k + 2] for piece in pieces for k in range(len(piece) - 1)}
        #: whether no piece goes on across the blank before a word
        self.by_blank = not any(x[1] == MARK and x[0] != MARK for x in self.joined)
        self.known: dict[str, Best] = {}
        self.before: dict[str, Best] = {}

    def _tree(self, pieces: list[tuple], depth: int) -> dict | None:
        """The tree of pieces, sorted, that are longer than depth and share so many characters."""
        out = {}
        for c, group in groupby((x for x in pieces if len(x[0]) > depth), key=lambda x: x[0][depth]):
            group = list(group)
            out[c] = (group[0][1] if len(group[0][0]) == depth + 1 else None, self._tree(group, depth + 1))
        return out or None

    def _unknown(self, c: str) -> Found:
        """A character without a piece: the pieces of its bytes."""
        return self.worst, b"".join([self.bytes.get(b, self.unk).to_bytes(4, "little") for b in c.encode("utf-8", "surrogatepass")])

    def _best(self, s: str) -> Best:
        """Forward Viterbi: the best segmentation, of equal ones that of the shortest pieces from the end.

        The second best way to the end leaves the best one at some place of it, so its loss is the least
        that any of these places has to the second best way there.
        """
        size, tree = len(s), self.tree
        best, second, back = [-_NEVER] * (size + 1), [-_NEVER] * (size + 1), [None] * (size + 1)
        best[0] = 0.0
        for j in range(size):
            here, e, at = best[j], j, tree
            for c in s[j : j + self.longest]:
                e += 1
                hit = at.get(c)
                if hit is None:
                    if e > j + 1:
                        break
                    hit = (None, None)
                piece, at = hit
                if piece is None and e == j + 1:
                    piece = self._unknown(c)
                if piece is not None:
                    score = here + piece[0]
                    if score >= best[e]:
                        second[e], best[e], back[e] = best[e], score, (j, piece)
                    elif score > second[e]:
                        second[e] = score
                if at is None:
                    break
        gap, score, ids, at = _NEVER, 0.0, [], size
        while at:
            gap = min(gap, best[at] - second[at])
            at, piece = back[at]
            score += piece[0]
            ids.append(piece[1])
        return score, b"".join(ids[::-1]), gap

    def _edges(self, s: str, j: int) -> list[tuple[int, float, tuple]]:
        """(end, score, ids) of the lattice's edges from j."""
        found, e, at = [], j, self.tree
        for c in s[j : j + self.longest]:
            e += 1
            piece, at = at.get(c, (None, None))
            if piece is None and e == j + 1:
                piece = self._unknown(c)
            if piece is not None:
                found.append((e, piece[0], tuple(array("I", piece[1]))))
            if at is None:
                break
        return found

    def _lattice(self, s: str) -> tuple[list[float], list[list[tuple]]]:
        """As in _best, the best score up to each position; and all edges (from, score, ids) into it."""
        best, into = [0.0] + [-_NEVER] * len(s), [[] for _ in range(len(s) + 1)]
        for j in range(len(s)):
            for e, score, ids in self._edges(s, j):
                into[e].append((j, score, ids))
                best[e] = max(best[e], best[j] + score)
        return best, into

    def search(self, s: str) -> list[Found]:
        """The n best segmentations of a part, best scores first.

        Backward A*: what a path has from the end, and the best score up to where it begins, is what its
        best completion has. So of the ways on from a path only the n best can be among the n best of all.
        Of equal scores that of the path extended last comes first, and of its ways on the shortest piece.
        """
        best, into = self._lattice(s)
        n, size = self.n, len(s)
        out, heap, count = [], [(-best[size], 0, size, 0.0, None)], 0
        while heap:
            _, _, at, score, path = heappop(heap)
            if not at:
                ids = array("I")
                while path:
                    ids.extend(path[0])
                    path = path[1]
                out.append((score, ids.tobytes()))
                if len(out) == n:
                    break
                continue
            ways = [(-(score + edge + best[j]), j, score + edge, ids) for j, edge, ids in into[at]]
            if len(ways) > n:
                ways = sorted(reversed(ways), key=_total)[:n][::-1]
            for total, j, reached, ids in ways:
                count -= 1  # of equal totals the latest comes first: straight to the start
                heappush(heap, (total, count, j, reached, (ids, path)))
        return out

    def _parts(self, word: str) -> list[str]:
        """A word cut where no piece holds both neighbours."""
        joined = self.joined
        cuts = [0, *[k for k in range(1, len(word)) if word[k - 1 : k + 1] not in joined], len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])] if len(cuts) > 2 else [word]

    def _learn(self, word: str) -> Best:
        """Searches a word, part by part, or takes it over from the generation before."""
        found = self.before.get(word)
        if found is None:
            parts = self._parts(word)
            if len(parts) == 1:
                found = self._best(word)
            else:
                known = self.known
                of = [known[p] if p in known else self._learn(p) for p in parts]
                found = (sum([x[0] for x in of]), b"".join([x[1] for x in of]), min([x[2] for x in of]))
        self.known[word] = found
        return found

    def best_of_all(self, words: list[str], bests: list[Best]) -> list[Found]:
        """The n best ways through words in a row. Only the n - 1 cheapest single departures from the
        best way can occur in them: any other way is beaten by the best and by each of those alone."""
        scores, ids, gaps = (list(x) for x in zip(*bests))
        total, cheap, rest = sum(scores), [], gaps
        # the second best of each part first: only parts among those can have a third best that counts
        for _ in range(self.n - 1):
            gap = min(rest)
            if gap == _NEVER:
                break
            i = rest.index(gap)
            rest[i] = _NEVER
            parts = self._parts(words[i])
            of = [self.search(p) for p in parts]
            for k, found in enumerate(of):
                for other in found[1:]:
                    new = b"".join([*(x[0][1] for x in of[:k]), other[1], *(x[0][1] for x in of[k + 1 :])])
                    cheap.append((found[0][0] - other[0], i, k, new, other[1]))
        cheap = sorted(cheap, key=lambda x: x[:3])[: self.n - 1]
        ways = [(0.0, ())]
        for size in range(1, len(cheap) + 1):
            ways += [(sum(c[0] for c in way), way) for way in combinations(cheap, size) if len({c[1:3] for c in way}) == size]
        out = []
        for loss, way in sorted(ways, key=lambda x: (x[0], [c[:3] for c in x[1]]))[: self.n]:
            now = list(ids)
            for i in {c[1] for c in way}:
                now[i] = self._departed(words[i], [c for c in way if c[1] == i])
            out.append((total - loss, b"".join(now)))
        return out

    def _departed(self, word: str, departures: list[tuple]) -> bytes:
        """The ids of a word with these departures from its best way, each in a part of its own."""
        if len(departures) == 1:
            return departures[0][3]
        new = {c[2]: c[4] for c in departures}
        return b"".join([new[k] if k in new else self._best(p)[1] for k, p in enumerate(self._parts(word))])

    def encode(self, text: str) -> list[Found]:
        """The n best segmentations of a whole text; an empty text has one, without pieces.

        A blank is put before the text; blanks are the mark's. The mark itself and characters outside
        the vocabulary become bytes, so decode() gives the text back.
        """
        if not text:
            return [(0.0, b"")]
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        if MARK in text or not self.by_blank:
            pieces = [x for x in re.split(f"({MARK})", " " + text) if x]
            words = [x.replace(" ", MARK) for x in pieces]
            return self.best_of_all(words, [self._mark() if x == MARK else self.known.get(w) or self._learn(w) for x, w in zip(pieces, words)])
        words = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + text.replace(" ", MARK)) if "  " in text or text[0] == " " or text[-1] == " " else (MARK + text.replace(" ", " " + MARK)).split(" ")
        bests = list(map(self.known.get, words))
        if None in bests:
            known, learn = self.known, self._learn
            bests = [known.get(w) or learn(w) if x is None else x for w, x in zip(words, bests)]
        return self.best_of_all(words, bests)

    def _mark(self) -> Best:
        """A mark of the text itself, which is no piece."""
        return *self._unknown(MARK), _NEVER

    def decode(self, ids: bytes) -> str:
        """The text of ids, without the blank that encode() puts before it."""
        return b"".join(map(self.text_of.__getitem__, array("I", ids)))[1:].decode("utf-8", "surrogatepass")


_loaded: dict[tuple[str, int], Segmenter] = {}


def segmenter(path: str, n: int = NBEST) -> Segmenter:
    """This worker's segmenter of a model file."""
    if (path, n) not in _loaded:
        gc.set_threshold(200_000)  # what is remembered holds no cycles; looking for them often costs a tenth of the time
        _loaded[path, n] = Segmenter(path, n)
    return _loaded[path, n]


def encode_nbest(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", n: int = NBEST) -> DataFrame:
    """(doc_id, segmentations array<struct<score, ids binary>>, decoded) of every row, best first.

    decoded is the text that the best ids give. Null text counts as empty; null ids and repeated rows
    stay; an empty table gives no rows. Of equal scores comes first the best way itself, then departures
    in the order of the text; within a part the order of search(). Other columns of docs are not read.
    """
    kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.binary())]))

    def run(batches):
        s = segmenter(model, n)
        for b in text_groups(batches, most=1 << 20):
            found = [s.encode(t) for t in b.column("text").to_pylist()]
            rows = [[{"score": x, "ids": ids} for x, ids in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind), pa.array([s.decode(f[0][1]) for f in found])], names=["doc_id", "segmentations", "decoded"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), small_text(docs[text_col]).alias("text"))
    return rows.mapInArrow(run, "doc_id long, segmentations array<struct<score: double, ids: binary>>, decoded string")


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_pieces, score, ids_crc32, nbest_scores, nbest_crc32, decoded_sha256) of encode_nbest's rows."""
    best = F.col("segmentations")[0]
    crc = F.transform("segmentations", lambda s: F.crc32(s["ids"]).cast("string"))
    scores = F.transform("segmentations", lambda s: F.round(s["score"], 3).cast("string"))
    return found.select("doc_id", (F.octet_length(best["ids"]) / 4).cast("long").alias("n_pieces"), best["score"].alias("score"), F.crc32(best["ids"]).alias("ids_crc32"), F.array_join(scores, " ").alias("nbest_scores"), F.array_join(crc, " ").alias("nbest_crc32"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
