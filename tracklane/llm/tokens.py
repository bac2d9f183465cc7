"""Token ids of whole texts, as the tokenizers library gives them, at a fraction of its time.

A byte-level BPE never merges across pre-tokens, and a pre-token never spans a single ASCII space between two
characters that are not white space. So a text is cut at such spaces, each distinct chunk is encoded once, and a
text's ids are its chunks' ids in a row. Texts with other white space around a space are encoded whole.
It is cut as well at single line ends between two such characters, which are pre-tokens of their own. A piece of letters is one
pre-token: the library's model gets it without the search for pre-tokens. Chunks are cut and told apart for a batch of
texts at once, by Arrow, and their ids are put in a row by numpy.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_KEPT = 1_800_000
JOINED = 16
JOINED_CHARS = 6 << 20
MARKS = ".,;:!?$%&*#|)]}\""
#: Outside of these `str.isalpha` is what the tokenizer takes for letters.
UNSURE = re.compile("[\u00b2\u00b3\u00b9\u00bc-\u00be\u0250-\U0010ffff]")
#: A line end between two characters that are not white space.
LINE = re.compile(r"\n(?=\S)(?<=\S\n)")
#: White space to Python's str methods, but not to the tokenizer.
ODD = "\x1c\x1d\x1e\x1f"

#: Characters that a byte-level tokenizer's model has for bytes.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
OF_BYTE = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SEEN)))}
_CODES = np.array([ord(OF_BYTE.get(b, chr(b))) for b in range(256)], "<u4")

_kept: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of texts for one byte-level tokenizer without normaliser; keeps about MAX_KEPT chunks and words at most."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        line = self.tok.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.heads: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_heads: dict[str, bytes] = {}
        self.old_rest: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One per Python worker, kept from task to task."""
        if path not in _kept:
            _kept[path] = cls(path)
        return _kept[path]

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, self.dtype).tobytes() for e in found]

    def _join(self, parts: list[str]) -> list[bytes]:
        """Ids of each part; parts without line ends are encoded JOINED at a time, with a line end between any two."""
        out: dict[str, bytes] = {}
        easy = [c for c in parts if "\n" not in c] if self.line is not None else []
        runs = [easy[i:i + JOINED] for i in range(0, len(easy), JOINED)]
        for run, ids in zip(runs, self.whole(["\n".join(r) for r in runs])):
            ids = np.frombuffer(ids, self.dtype)
            ends = np.flatnonzero(ids == self.line).tolist()
            if len(ends) == len(run) - 1:
                out.update((c, ids[a:b].tobytes()) for c, a, b in zip(run, [0, *(e + 1 for e in ends)], [*ends, len(ids)]))
        hard = [c for c in parts if c not in out]
        out.update(zip(hard, self.whole(hard)))
        return [out[c] for c in parts]

    def _words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word of letters, with or without a space before it, and its ids: it is a pre-token as it stands."""
        tokenize = self.tok.model.tokenize
        seen = _CODES[np.frombuffer("\n".join(words).encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids, ends = [], [0]
        for word in seen.split(OF_BYTE[10]) if words else ():
            ids += [t.id for t in tokenize(word)]
            ends.append(len(ids))
        raw, ends = np.array(ids, self.dtype).tobytes(), [self.dtype.itemsize * e for e in ends]
        return zip(words, [raw[a:b] for a, b in zip(ends, ends[1:])])

    def _learn(self, kept: dict[str, bytes], new: list[str], before: str) -> None:
        """Encode new chunks: lines by themselves, a word with only marks behind it by its parts, others as they stand."""
        if not new:
            return
        new = [c for c in new if c and c.isprintable() and c[0] != " " or self._regular(c)]
        if self.line is not None:
            cut = [(c, c.split("\n")) for c in new if "\n" in c]
            cut = [(c, lines) for c, lines in cut if all(map(self._regular, lines))]
            if cut:
                new = list(set(new) - {c for c, _ in cut} | {lines[0] for _, lines in cut if lines[0] not in kept})
                heads = {x for _, lines in cut for x in lines[1:] if x not in self.heads}
                self._learn(self.heads, self._new(self.heads, self.old_heads, heads), "")
        words, tails, other = self.words, self.tails, []
        bare = [c.rstrip(MARKS) for c in new]
        keys = [before + w if w.isalpha() and (c.isascii() or not UNSURE.search(c)) else None for c, w in zip(new, bare)]
        todo = self._new(words, self.old_words, {k for k in keys if k is not None and k not in words})
        words.update(self._words(todo))
        for c, w, k in zip(new, bare, keys):
            if k is None:
                other.append(c)
                continue
            ids = words[k]
            if len(w) < len(c):
                end = c[len(w):]
                if end not in tails:
                    tails[end] = self.whole([end])[0]
                ids += tails[end]
            kept[c] = ids
        kept.update(zip(other, self._join([before + c for c in other])))
        if self.line is not None:
            line = self.dtype.type(self.line).tobytes()
            kept.update([(c, line.join([kept[lines[0]], *(self.heads[x] for x in lines[1:])])) for c, lines in cut])

    def _learn_rest(self, new: list[str]) -> None:
        """Encode new chunks behind a space or, if they begin with one, behind a line end."""
        lines = [c for c in new if c[:1] == "\n"] if self.line is not None else []
        if lines:
            new = [c for c in new if c[:1] != "\n"]
            heads = self.heads
            self._learn(heads, self._new(heads, self.old_heads, {c[1:] for c in lines}.difference(heads)), "")
            line = self.dtype.type(self.line).tobytes()
            self.rest.update((c, line + heads[c[1:]]) for c in lines if c[1:] in heads)
        self._learn(self.rest, new, " ")

    def _word_ids(self, keys: list[str]) -> list[bytes]:
        """Ids of words of letters, with or without a space before them."""
        words = self.words
        found = list(map(words.get, keys))
        if None in found:
            todo = self._new(words, self.old_words, {k for k, ids in zip(keys, found) if ids is None})
            words.update(self._words(todo))
            found = list(map(words.__getitem__, keys))
        return found

    def _rest_ids(self, chunks: pa.StringArray) -> list[bytes | None]:
        """Ids of distinct chunks behind a space; None where the text has to be encoded whole.

        Arrow tells letters with or without marks behind them from other chunks; only these are kept as chunks.
        """
        bare = pc.ascii_rtrim(chunks, characters=MARKS)
        easy = pc.and_not(pc.utf8_is_alpha(bare), pc.match_substring_regex(bare, UNSURE.pattern))
        sizes = pc.utf8_length(bare).to_numpy()
        marked = np.flatnonzero(easy.to_numpy(zero_copy_only=False) & (pc.utf8_length(chunks).to_numpy() > sizes))
        keys = pc.binary_join_element_wise(" ", bare.filter(easy), "")
        easy = easy.to_numpy(zero_copy_only=False)
        found = np.empty(len(chunks), object)
        found[easy] = self._word_ids(keys.to_numpy(zero_copy_only=False).tolist())
        hard = chunks.filter(pa.array(~easy)).to_numpy(zero_copy_only=False).tolist()
        self._learn_rest(self._new(self.rest, self.old_rest, set(hard).difference(self.rest)))
        found[~easy] = list(map(self.rest.get, hard))
        found, tails = found.tolist(), self.tails
        for k, c, n in zip(marked.tolist(), chunks.take(pa.array(marked)).to_pylist(), sizes[marked].tolist()):
            end = c[n:]
            if end not in tails:
                tails[end] = self.whole([end])[0]
            found[k] += tails[end]
        return found

    def documents(self, rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
        """doc_id and ids of rows (doc_id, text); batches of about JOINED_CHARS characters are encoded at a time."""
        docs, texts, size = [], [], 0
        for batch in rows:
            docs += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
            size += batch.column(1).nbytes
            if size >= JOINED_CHARS:
                yield from zip(docs, self.encode(texts))
                docs, texts, size = [], [], 0
        yield from zip(docs, self.encode(texts))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        if len(self.heads) + len(self.rest) + len(self.words) + len(self.tails) > MAX_KEPT // 2:  # what is met again comes back from the older half
            self.old_heads, self.heads, self.old_rest, self.rest, self.tails = self.heads, {}, self.rest, {}, {}
            self.old_words, self.words = self.words, {}
        # a line end is put before the chunk behind it, as a space is; where the text itself has both, it is encoded whole
        lines = [LINE.sub(" \n", t) if "\n" in t else t for t in texts] if self.line is not None else texts
        cut = [t.partition(" ") for t in lines]
        chunks = pc.split_pattern(pa.array([rest if space else None for _, space, rest in cut], pa.string()), " ")
        coded = chunks.flatten().dictionary_encode()
        places, found = coded.indices.to_numpy(), self._rest_ids(coded.dictionary)
        others = len(found)
        heads = [head for head, _, _ in cut]
        self._learn(self.heads, self._new(self.heads, self.old_heads, {c for c in heads if c not in self.heads}), "")
        # the ids of chunks, then those of first chunks, of each text its first chunk and the others in a row
        found += map(self.heads.get, heads)
        unknown = [k for k, ids in enumerate(found) if ids is None] if None in found else []
        for k in unknown:
            found[k] = b""
        lengths = 1 + pc.fill_null(pc.list_value_length(chunks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        firsts = np.cumsum(lengths) - lengths
        which = np.empty(lengths.sum(), np.int64)
        later = np.ones(len(which), bool)
        later[firsts] = False
        which[later], which[firsts] = places, others + np.arange(len(texts))
        ids = np.frombuffer(b"".join(found), self.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        starts, many = (np.cumsum(sizes) - sizes)[which], sizes[which]
        ends = np.cumsum(many)
        ids = ids[np.repeat(starts - (ends - many), many) + np.arange(ends[-1])]
        cuts = np.concatenate([[0], ends])[[*firsts, len(which)]].tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        odd = {i for i, t in enumerate(texts) if " \n" in t} if self.line is not None else set()
        if unknown:
            lost = np.zeros(len(found), bool)
            lost[unknown] = True
            odd.update(np.flatnonzero(np.logical_or.reduceat(lost[which], firsts)).tolist())
        if odd:
            for i, raw in zip(odd, self.whole([texts[i] for i in odd])):
                out[i] = np.frombuffer(raw, self.dtype)
        return out

    @staticmethod
    def _new(kept: dict[str, bytes], old: dict[str, bytes], wanted: set[str]) -> list[str]:
        """What of `wanted` is in neither; what is in `old` moves to `kept`."""
        again = wanted & old.keys() if old else set()
        kept.update((c, old[c]) for c in again)
        return list(wanted - again)

    @staticmethod
    def _regular(c: str) -> bool:
        """No white space at either end, and none that only Python takes for such."""
        return bool(c) and (c.isprintable() or not (c[0].isspace() or c[-1].isspace() or any(o in c for o in ODD)))
