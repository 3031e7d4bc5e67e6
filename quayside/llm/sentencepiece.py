"""N-best segmentations of texts into the pieces of a SentencePiece model, and back.

The lattice of a text has an edge for every piece that fits somewhere. A forward Viterbi pass gives every position the best
score of what lies before it; used as the estimate of a backward A* search from the end, that score is exact, so
complete paths leave the agenda in the order of their scores.

No piece reaches over the start of a word, so the lattice of a text is a chain of the words' own lattices, and the n best of
the text come from those of its words: only the n - 1 words whose second best costs least can differ from their
best path. Viterbi scores from both ends tell what a second best costs, once per word and task; A* runs on the words
that can differ, and their paths are combined exactly.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import slices, text_bytes

SPACE = "▁"  # fixed value: what the format writes for a space
UNKNOWN_PENALTY = 10.0  # fixed value: how far an unknown character lies below the worst piece
#: Words that are searched at a time, and the longest of them; longer ones are searched alone.
TOGETHER, LONGEST = 20_000, 48
#: Words with a character without a piece are searched alone if they are fewer: a search together takes 6 ms at least.
FEW = 64


class Pieces:
    """A model's pieces with their scores, its normalisation, and the search over its lattices."""

    def __init__(self, path: str, n: int, remembered: int = 400_000):
        import numpy as np
        import pyarrow as pa
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n, self.half = n, remembered // 2
        ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.pieces = {m.id_to_piece(i): (i, m.get_score(i)) for i in ids}
        self.longest = max(map(len, self.pieces), default=1)
        # Pieces and, with None, the strings that only begin one: nothing longer has to be looked up after a miss.
        self.tree = {p[:i]: None for p in self.pieces for i in range(1, len(p))} | self.pieces
        number = {"": 0} | {p: i for i, p in enumerate(self.tree, 1)}
        steps = np.array([number[p[:-1]] << 21 | ord(p[-1]) for p in self.tree], np.int64)
        # The same tree as steps (node, character) to a node, whose id is -1 where it is no piece; the root has no step.
        self.steps = np.append(-1, steps)
        self.slots = self.hashed(steps)
        self.node_id = np.array([-1] + [v[0] if v else -1 for v in self.tree.values()], np.int64)
        self.node_score = np.array([0.0] + [v[1] if v else 0.0 for v in self.tree.values()])
        self.depth = np.array([1, *map(len, self.tree)], np.int64)
        self.is_piece, self.inner = self.node_id >= 0, np.zeros(len(self.tree) + 1, bool)
        self.inner[steps[steps >= 1 << 21] >> 21] = True
        # The node of a first character; 0, the root, where no piece begins with it.
        top = np.flatnonzero(steps < 1 << 21)
        self.first = np.zeros(0x110000, np.int32)
        self.first[steps[top]] = top + 1
        self.single = {p for p in self.pieces if len(p) == 1}
        self.byte_ids = {int(m.id_to_piece(i)[3:5], 16): i for i in range(m.get_piece_size()) if m.is_byte(i)}
        self.byte_id = np.zeros(256, np.int64)
        self.byte_id[list(self.byte_ids)] = list(self.byte_ids.values())
        self.penalty = min((s for _, s in self.pieces.values() if s > -1e8), default=0.0) - UNKNOWN_PENALTY
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if self.apart else r"[\s\S]+")
        self.surface = [b""] * m.get_piece_size()
        for piece, (i, _) in self.pieces.items():
            self.surface[i] = piece.replace(SPACE, " ").encode()
        for value, i in self.byte_ids.items():
            self.surface[i] = bytes([value])
        self.surface[m.unk_id()] = " ⁇ ".encode()  # fixed value: how the library prints an unknown piece
        self.surfaces = pa.array(self.surface, pa.large_binary())
        self.dummy = m.normalize("a") == SPACE + "a"
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.deep: dict[str, list] = {}

    @staticmethod
    def hashed(steps):
        """A hash table of the nodes the steps lead to: each in the first slot that was free from its own on, 0 in the others."""
        import numpy as np

        slots = np.zeros(1 << max(4, (8 * len(steps)).bit_length()), np.int32)
        node, at = np.arange(1, len(steps) + 1), slot(steps, len(slots))
        while len(node):
            free = slots[at] == 0
            slots[at[free]] = node[free]
            left = np.flatnonzero(slots[at] != node)
            node, at = node[left], at[left] + 1 & len(slots) - 1
        return slots

    def follow(self, steps):
        """The nodes that steps lead to, 0 where there is none."""
        import numpy as np

        at = slot(steps, len(self.slots))
        out = self.slots[at]
        open_ = np.flatnonzero((self.steps[out] != steps) & (out != 0))
        while len(open_):
            at[open_] = at[open_] + 1 & len(self.slots) - 1
            out[open_] = found = self.slots[at[open_]]
            open_ = open_[(self.steps[found] != steps[open_]) & (found != 0)]
        return out

    def edges(self, word: str) -> list[list[tuple]]:
        """For every position the edges that end there: (start, score, ids)."""
        pieces, longest, n = self.pieces, self.longest, len(word)
        out: list[list[tuple]] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, min(n, i + longest) + 1):
                found = pieces.get(word[i:j])
                if found is not None:
                    out[j].append((i, found[1], found[:1]))
            if word[i] not in pieces:
                out[i + 1].append(self.unknown(word[i], i))
        return out

    def paths(self, word: str) -> Iterator[tuple[float, tuple[int, ...]]]:
        """Segmentations of a word from best to worst; equal scores keep the order in which the search meets them."""
        into = self.edges(word)
        best = [0.0] * len(into)
        for j in range(1, len(into)):
            best[j] = max([best[i] + s for i, s, _ in into[j]])
        # An entry: minus the score of the best path through it, a running number, where it starts, its score, its pieces.
        agenda, number = [(-best[-1], 0, len(word), 0.0, None)], 0
        while agenda:
            worst, _, at, score, pieces = heapq.heappop(agenda)
            if not at:
                ids: list[int] = []
                while pieces is not None:
                    ids += pieces[0]
                    pieces = pieces[1]
                yield -worst, tuple(ids)
                continue
            for i, s, own in into[at]:
                number += 1
                total = score + s
                heapq.heappush(agenda, (-(best[i] + total), number, i, total, (own, pieces)))

    def best_two(self, word: str) -> tuple[bytes, float, float]:
        """Ids and score of a best path, and what the second best costs more.

        Any other path has an edge that is not on the best one, so the best path over one of those edges, which the scores
        from both ends give, is the second best.
        """
        tree, pieces, n = self.tree, self.pieces, len(word)
        none = float("-inf")
        ahead, back, edges = [none] * (n + 1), [None] * (n + 1), []
        ahead[0] = 0.0
        for i in range(n):
            here = ahead[i]
            for j in range(i + 1, n + 1):
                found = tree.get(word[i:j], 0)
                if found == 0:
                    break
                if found is not None:
                    edges.append((i, j, found[1]))
                    if here + found[1] > ahead[j]:
                        ahead[j], back[j] = here + found[1], (i, found[:1])
            if word[i] not in pieces:
                _, s, own = self.unknown(word[i], i)
                edges.append((i, i + 1, s))
                if here + s > ahead[i + 1]:
                    ahead[i + 1], back[i + 1] = here + s, (i, own)
        after, path, ids, at = [none] * (n + 1), set(), [], n
        after[n] = 0.0
        for i, j, s in reversed(edges):
            if after[j] + s > after[i]:
                after[i] = after[j] + s
        while at:
            i, own = back[at]
            path.add((i, at))
            ids.append(own)
            at = i
        second = max([ahead[i] + s + after[j] for i, j, s in edges if (i, j) not in path], default=none)
        return array("I", [x for own in reversed(ids) for x in own]).tobytes(), ahead[n], ahead[n] - second

    def best_twos(self, words: list[str]) -> list[tuple[bytes, float, float]]:
        """``best_two`` of many words, position by position for all of them at once."""
        import numpy as np

        # Longest first: those that go on after some character are the first so many.
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        flat = np.frombuffer("".join([words[w] for w in order.tolist()]).encode("utf-32-le"), "<u4")
        at, n = np.cumsum(sizes) - sizes, int(sizes[0])
        goes_on = np.searchsorted(-sizes, -np.arange(n + 1)).tolist()
        chars = [flat[at[:m] + i] for i, m in enumerate(goes_on[:n])]
        # By position and word: the best score from the start, and the node of the edge it ends with, the root for a
        # character without a piece.
        ahead = np.full((n + 1, len(words)), -np.inf)
        last, edges = np.zeros(ahead.shape, np.int32), []
        ahead[0] = 0.0
        for i, m in enumerate(goes_on[:n]):
            here, node = ahead[i], self.first[chars[i]]
            piece = self.is_piece[node]
            score, by, none = self.node_score[node], node * piece, np.flatnonzero(~piece)
            if len(none):
                score[none] = self.penalty * utf8_length(chars[i][none]) if self.byte_ids else self.penalty
            total = here[:m] + score
            better = total > ahead[i + 1, :m]
            np.copyto(ahead[i + 1, :m], total, where=better)
            np.copyto(last[i + 1, :m], by, where=better)
            edges.append((i, i + 1, slice(m), by, score))
            word = np.flatnonzero(self.inner[node[:goes_on[i + 1]]])
            node = node[word]
            for j in range(i + 2, n + 1):
                if not len(word):
                    break
                key = node.astype(np.int64) << 21 | chars[j - 1][word]
                node = self.follow(key)
                hit = np.flatnonzero(node)
                word, node = word[hit], node[hit]
                piece = np.flatnonzero(self.is_piece[node])
                to, by = word[piece], node[piece]
                score, there = self.node_score[by], ahead[j]
                total = here[to] + score
                better = np.flatnonzero(total > there[to])
                some = to[better]
                there[some], last[j][some] = total[better], by[better]
                edges.append((i, j, to, by, score))
                on = np.flatnonzero(self.inner[node] & (word < goes_on[j]))
                word, node = word[on], node[on]
        path = np.full(ahead.shape, -1, np.int32)
        word, at = np.arange(len(words)), sizes
        while len(word):
            node = last[at, word]
            at = at - self.depth[node]
            path[at, word] = node
            on = np.flatnonzero(at)
            word, at = word[on], at[on]
        after, second = np.full(ahead.shape, -np.inf), np.full(len(words), -np.inf)
        after[sizes, np.arange(len(words))] = 0.0
        for i, j, word, by, score in reversed(edges):
            rest, back = after[j][word], after[i]
            back[word] = np.maximum(back[word], rest + score)
            total = ahead[i][word] + score + rest
            total[path[i][word] == by] = -np.inf
            second[word] = np.maximum(second[word], total)
        word, at = np.nonzero(path.T >= 0)
        node = path[at, word]
        ids, none = self.node_id[node], np.flatnonzero(node == 0)
        count = np.ones(len(ids), np.int64)
        if len(none):
            first = np.cumsum(sizes) - sizes
            strange = flat[first[word[none]] + at[none]]
            if self.byte_ids:
                raw = np.frombuffer(strange.tobytes().decode("utf-32-le").encode(), np.uint8)
                count[none] = utf8_length(strange)
                ids = np.repeat(ids, count)
                ids[np.repeat(node == 0, count)] = self.byte_id[raw]
            else:
                ids[none] = self.model.unk_id()
        ids = ids.astype("<u4").tobytes()
        cuts = [0, *(np.cumsum(np.bincount(word, count, len(words))).astype(np.int64) * 4).tolist()]
        best = ahead[sizes, np.arange(len(words))]
        out = list(zip([ids[a:b] for a, b in zip(cuts, cuts[1:])], best.tolist(), (best - second).tolist()))
        return [out[w] for w in np.argsort(order).tolist()]

    def unknown(self, character: str, at: int) -> tuple:
        """The edge of a character that is no piece."""
        raw = character.encode()
        if self.byte_ids:
            return at, self.penalty * len(raw), tuple(self.byte_ids[b] for b in raw)
        return at, self.penalty, (self.model.unk_id(),)

    def learn(self, words: set[str]) -> None:
        """Best path and the cost of the second best for words not met before."""
        if len(self.known) > self.half:
            self.known, self.older, self.deep = {}, self.known, {}
        new = []
        for word in words.difference(self.known):
            found = self.older.get(word)
            if found is None:
                new.append(word)
            else:
                self.known[word] = found
        short = [w for w in new if 0 < len(w) <= LONGEST]
        strange = list(islice((w for w in short if not self.single.issuperset(w)), FEW))
        alone = {w for w in new if not 0 < len(w) <= LONGEST}.union(strange if len(strange) < FEW else ())
        self.known.update((w, self.best_two(w)) for w in alone)
        plain = sorted([w for w in short if w not in alone], key=len)
        for at in range(0, len(plain), TOGETHER):
            some = plain[at:at + TOGETHER]
            self.known.update(zip(some, self.best_twos(some)))

    def alternatives(self, word: str) -> list[tuple[float, bytes]]:
        """What the n best paths of a word cost more than its best, and their ids."""
        import numpy as np

        found = self.deep.get(word)
        if found is None:
            some = [p for p, _ in zip(self.paths(word), range(self.n))]
            found = self.deep[word] = [(some[0][0] - s, np.array(ids, "<u4").tobytes()) for s, ids in some]
        return found

    def encode(self, texts: list[str]) -> list[list[tuple[float, bytes]]]:
        """``encode_normal`` of texts as they come."""
        return self.encode_normal(self.model.normalize(texts))

    def encode_normal(self, texts: list[str]) -> list[list[tuple[float, bytes]]]:
        """The n best (score, ids as little-endian unsigned 32-bit integers) of each normalised text; a text with fewer
        has fewer.

        Equal scores are ordered by the ranks of the words' paths, first word first.
        """
        import numpy as np
        import pyarrow as pa

        words, firsts = self.words(texts)
        words = words.dictionary_encode()
        distinct, codes = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices
        self.learn(set(distinct))
        found, out = [self.known[w] for w in distinct], []
        data = pa.array([f[0] for f in found], pa.large_binary()).take(codes)
        cuts, data = np.frombuffer(data.buffers()[1], "int64", len(data) + 1), memoryview(data.buffers()[2] or b"")
        codes = codes.to_numpy()
        tops, more = (np.array([f[k] for f in found], float)[codes] for k in (1, 2))
        for first, end in zip(firsts, firsts[1:]):
            top = sum(tops[first:end].tolist())
            places = self.places(more[first:end])
            best = [(0.0, ())]
            some = [self.alternatives(distinct[codes[first + at]]) for at in places]
            for others in some:
                best = sorted((loss + more, ranks + (r,)) for loss, ranks in best for r, (more, _) in enumerate(others))[:self.n]
            # What stays between the words that can differ.
            ends = cuts[[first, *(first + at + k for at in places for k in (0, 1)), end]].tolist()
            kept = [data[i:j] for i, j in zip(ends[::2], ends[1::2])]
            mine = []
            for loss, ranks in best[:self.n]:
                parts = kept[:1]
                for others, r, rest in zip(some, ranks, kept[1:]):
                    parts += others[r][1], rest
                mine.append((top - loss, b"".join(parts)))
            out.append(mine)
        return out

    def words(self, texts: list[str]) -> tuple:
        """What ``word`` finds in all texts, as an Arrow array, and where those of each text begin there, with their number."""
        import numpy as np
        import pyarrow as pa

        texts = pa.array(texts, pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], "int64", len(texts) + 1) if len(texts) else np.zeros(1, "int64")
        raw = np.frombuffer(texts.buffers()[2] or b"", "u1")[:ends[-1]]
        begins = np.zeros(len(raw), bool)
        begins[ends[:-1][np.diff(ends) > 0]] = True
        if self.apart:
            a, b, c = SPACE.encode()
            at = np.flatnonzero(raw == a)
            at = at[(raw[at + 1] == b) & (raw[at + 2] == c)]
            begins[at[np.diff(at, prepend=-4) != 3]] = True
        starts = np.flatnonzero(begins)
        cuts = np.append(starts, ends[-1])
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts), texts.buffers()[2])
        return words, np.searchsorted(starts, ends).tolist()

    def places(self, more) -> list[int]:
        """Of a text's words the n - 1 whose second best costs least, later ones first among equals, in their order."""
        import numpy as np

        k = min(self.n - 1, len(more))
        if not k:
            return []
        few = np.flatnonzero((more <= np.partition(more, k - 1)[k - 1]) & (more != float("inf")))
        return sorted(-i for _, i in sorted(zip(more[few].tolist(), (-few).tolist()))[:k])

    def decode(self, ids: bytes) -> str:
        """The text of a sequence of ids; bytes that are no UTF-8 become replacement characters."""
        return self.decode_all([ids])[0]

    def decode_all(self, rows: list[bytes]) -> list[str]:
        """``decode`` of each sequence."""
        import numpy as np
        import pyarrow as pa

        ids = np.frombuffer(b"".join(rows), "<u4")
        ends = np.cumsum([0, *(len(r) // 4 for r in rows)])
        found = self.surfaces.take(pa.array(ids))
        cuts = np.frombuffer(found.buffers()[1], "int64", len(ids) + 1)[ends].tolist() if len(ids) else [0] * len(ends)
        data, out = memoryview(found.buffers()[2] or b""), []
        for a, b in zip(cuts, cuts[1:]):
            text = bytes(data[a:b])
            out.append((text[1:] if self.dummy and text[:1] == b" " else text).decode(errors="replace"))
        return out


def slot(steps, n: int):
    """Where a hash table of n slots, a power of two, has steps at first."""
    return (steps.astype("u8") * 0x9E3779B97F4A7C15 >> 65 - n.bit_length()).astype("i8")


def utf8_length(characters):
    """Bytes of each character in UTF-8."""
    return 1 + (characters >= 0x80) + (characters >= 0x800) + (characters >= 0x10000).astype("int64")


def encode(df: DataFrame, model: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = True) -> DataFrame:
    """A row for each of the n best segmentations of each text: doc_id, rank from 1, score, n_pieces, ids_crc32 (of the
    ids as little-endian unsigned 32-bit integers), round_trip (decoding gives the normalised text), and the ids unless
    ``with_ids`` is off.

    A null or empty text has one segmentation without pieces and score 0. Characters without a piece become their
    bytes' pieces, each as far below the worst piece as the library puts unknown ones. Every row is
    encoded, repeated and null ids too; other columns are left out. An empty table gives no rows.
    """
    def run(batches):
        import zlib

        import pyarrow as pa

        pieces = Pieces(model, n)
        for whole in batches:
            for batch in slices(whole, 2 << 20):
                texts, rows = pieces.model.normalize([t.decode() for t in batch.column("text").to_pylist()]), []
                coded = pieces.encode_normal(texts)
                decoded = iter(pieces.decode_all([ids for found in coded for _, ids in found]))
                for doc, plain, found in zip(batch.column("doc_id").to_pylist(), texts, coded):
                    plain = plain.replace(SPACE, " ")
                    plain = plain[1:] if pieces.dummy and plain[:1] == " " else plain
                    for rank, (score, ids) in enumerate(found, 1):
                        rows.append((doc, rank, score, len(ids) // 4, zlib.crc32(ids), next(decoded) == plain, ids))
                columns = list(zip(*rows))[:len(types)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    import pyarrow as pa

    names = ["doc_id", "rank", "score", "n_pieces", "ids_crc32", "round_trip", "ids"][:7 if with_ids else 6]
    types = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()][:len(names)]
    schema = "doc_id long, rank int, score double, n_pieces long, ids_crc32 long, round_trip boolean" + ", ids binary" * with_ids
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(run, schema)
