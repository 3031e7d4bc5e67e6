"""Token ids of whole texts, with a memory of the pieces of text that come again."""

from __future__ import annotations

import os
import re

# The characters the tokenizer's own pattern takes for white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WIDE = [chr(i).encode() for i in range(0x80, 0x3001) if re.match(f"[{SPACE}]", chr(i))]
#: Units that are encoded as one text, and texts that are encoded at once.
AT_ONCE, TEXTS = 1000, 32
#: Bytes of a unit that may be remembered.
SHORT = 64


def spaces(data):
    """Which bytes of some UTF-8 belong to white space."""
    import numpy as np

    table = np.zeros(256, bool)
    table[[ord(c) for c in "\t\n\x0b\x0c\r "]] = True
    found = table[data]
    lead = np.zeros(256, bool)
    lead[[c[0] for c in WIDE]] = True
    at = np.flatnonzero(lead[data])
    if len(at):
        padded = np.append(data, np.zeros(2, np.uint8))
        one, two, three = (padded[at + i].astype(np.int64) for i in range(3))
        for size, code in ((2, one << 8 | two), (3, one << 16 | two << 8 | three)):
            some = at[np.isin(code, [int.from_bytes(c, "big") for c in WIDE if len(c) == size])]
            for i in range(size):
                found[some + i] = True
    return found


def cut_places(data, starts):
    """Where the units of some texts in UTF-8 start, which follow each other in ``data``; they start at ``starts``."""
    import numpy as np

    space = spaces(data)
    new = np.zeros(len(data), bool)
    new[1:] = space[1:] & ~space[:-1]
    # ASCII punctuation behind a letter or a digit, in ASCII or Latin-1.
    mark, plain = np.zeros(256, bool), np.zeros(256, bool)
    mark[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
    plain[[i for i in range(128) if chr(i).isalnum()]] = True
    at = np.flatnonzero(mark[data[1:]])
    before = data[at]
    latin = (data[at - 1] == 0xC3) & (at > 0) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
    new[at[plain[before] | latin] + 1] = True
    new[starts[starts < len(data)]] = True
    return np.flatnonzero(new)


def as_arrow(offsets, data, kind):
    """A large Arrow array of strings or bytes over a buffer."""
    import numpy as np
    import pyarrow as pa

    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)]
    return pa.Array.from_buffers(kind, len(offsets) - 1, buffers)


def as_numpy(values) -> tuple:
    """The offsets, from 0 on, and the bytes of a large Arrow array of strings or bytes without nulls."""
    import numpy as np

    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int64, len(values) + 1, values.offset * 8) if len(values) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return ends - ends[0], data[ends[0]:ends[-1]]


class Encoder:
    """Byte-level BPE ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer splits a text before every run of white space that follows another character, and between a letter or
    a digit and the punctuation behind it. So a text's ids are those of its units, which are cut there, one after
    another. Units come again and again: those of up to ``SHORT`` bytes are remembered as Arrow arrays of at most about
    ``remembered`` bytes, in two generations; the older one is forgotten when the younger one is half of that.

    Texts that hold the literal of an added token, such as <|endoftext|>, are encoded as a whole by the tokenizer.
    """

    def __init__(self, path: str, remembered: int = 64 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = "|".join(map(re.escape, added))
        self.half = remembered // 2
        self.young, self.older = self._nothing(), self._nothing()
        # A token is written with one character per byte.
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, "int64")
        self.sizes[list(vocabulary.values())] = [len(token) for token in vocabulary]

    @staticmethod
    def _nothing() -> tuple:
        import pyarrow as pa

        return pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def remembered(self) -> int:
        """Bytes of the units that are remembered, with their ids."""
        return sum(part.nbytes for kept in (self.young, self.older) for part in kept)

    def _single(self, units: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _new(self, units):
        """Ids of an Arrow array of units never met. Those that can follow each other in a text are encoded as one text, and
        cut where the bytes of the tokens reach the end of a unit."""
        import numpy as np
        import pyarrow as pa

        ends, data = as_numpy(units)
        space = spaces(data)
        chained = space[ends[:-1]] & ~space[ends[1:] - 1]
        chain, apart = np.flatnonzero(chained), np.flatnonzero(~chained)
        ids, counts = [], []
        ends, data = as_numpy(units.take(pa.array(chain)))
        places = [(at, min(at + AT_ONCE, len(chain))) for at in range(0, len(chain), AT_ONCE)]
        for some in (places[i:i + TEXTS] for i in range(0, len(places), TEXTS)):
            texts = [data[ends[a]:ends[b]].tobytes().decode() for a, b in some]
            for (a, b), e in zip(some, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                made = np.array(e.ids, "<u4")
                wanted, reached = ends[a + 1:b + 1] - ends[a], np.cumsum(self.sizes[made])
                cuts = np.searchsorted(reached, wanted)
                if cuts[-1] != len(made) - 1 or (reached[cuts] != wanted).any():
                    alone = self._single(units.take(pa.array(chain[a:b])).to_pylist())
                    made, cuts = np.frombuffer(b"".join(alone), "<u4"), np.cumsum([len(x) // 4 for x in alone]) - 1
                ids.append(made)
                counts.append(np.diff(cuts, prepend=-1))
        alone = self._single(units.take(pa.array(apart)).to_pylist())
        ids.append(np.frombuffer(b"".join(alone), "<u4"))
        counts.append(np.array([len(x) // 4 for x in alone], np.int64))
        made = as_arrow(np.concatenate([[0], np.cumsum(np.concatenate(counts)) * 4]), np.concatenate(ids), pa.large_binary())
        place = np.empty(len(units), np.int64)
        place[np.concatenate([chain, apart])] = np.arange(len(units))
        return made.take(pa.array(place))

    def _units(self, units):
        """The ids of each of an Arrow array of distinct units."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        sources, at = [], None
        for words, ids in (self.young, self.older):
            place = pc.add(pc.index_in(units, value_set=words), sum(map(len, sources)))
            at = place if at is None else pc.coalesce(at, place)
            sources.append(ids)
        met, new = pc.is_valid(at), pc.filter(units, pc.is_null(at))
        sources.append(self._new(new))
        fresh = pa.array(np.arange(len(new), dtype=np.int32))
        at = pc.replace_with_mask(at, pc.invert(met), pc.cast(pc.add(fresh, sum(map(len, sources[:-1]))), at.type))
        found = pa.concat_arrays(sources).take(at)
        # What is not among the younger ones joins them.
        short = pc.and_(pc.greater_equal(at, len(self.young[0])), pc.less_equal(pc.binary_length(units), SHORT))
        self.young = tuple(pa.concat_arrays([kept, pc.filter(more, short)]) for kept, more in zip(self.young, (units, found)))
        if sum(part.nbytes for part in self.young) > self.half:
            self.young, self.older = self._nothing(), self.young
        return found

    def encode(self, texts) -> list[bytes]:
        """The ids of each text of an Arrow array of strings, or of their bytes, without nulls: the distinct units of all are
        looked up at once."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return []
        texts = texts.cast(pa.large_string())
        starts, data = as_numpy(texts)
        at = cut_places(data, starts)
        coded = as_arrow(np.append(at, len(data)), data, pa.large_string()).dictionary_encode()
        ends, ids = as_numpy(self._units(coded.dictionary).take(coded.indices))
        ends, ids = ends[np.searchsorted(at, starts)].tolist(), memoryview(ids)
        out = [bytes(ids[a:b]) for a, b in zip(ends, ends[1:])]
        if self.added:
            special = np.flatnonzero(pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False)).tolist()
            for row in special:
                ids = self.tokenizer.encode(texts[row].as_py(), add_special_tokens=False).ids
                out[row] = np.array(ids, "<u4").tobytes()
        return out
