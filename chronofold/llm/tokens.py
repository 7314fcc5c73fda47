"""Whole texts to token ids by way of their distinct pieces.

A tokenizer's ids of a text are the ids of its pieces put together, as long as the cuts fall where no match of the
tokenizer's own splitting can reach across. Each worker keeps the ids of the pieces it met, so the library encodes
a piece once per worker instead of once per occurrence, and NumPy gathers the ids of whole batches.

Cuts: for a word tokenizer, whose normalizer turns white space into single blanks and whose splitting drops them,
every run of ASCII white space. For a byte-level tokenizer with the usual " ?word" splitting, a blank or a newline that has
a character other than white space on both sides, the blank going with what follows it. Texts with any other white space
next to a blank or newline are cut only at their safe blanks.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept per worker, and their characters; beyond either, those that were not met again since the last time go.
KEPT, KEPT_CHARS = 400_000, 8_000_000
#: A blank or newline at either end of a text, or beside white space; or the separator itself.
_UNEVEN = r"^[ \n]|[ \n]$|[ \n][\s\x0b\x1c-\x1f\x{85}\p{Z}]|[\s\x0b\x1c-\x1f\x{85}\p{Z}][ \n]|\x00"
_SAFE_BLANK = re.compile(r"(?<=\S)(?= \S)")
_made: dict[tuple[str, str], "PieceEncoder"] = {}


def whole(texts: pa.Array) -> pa.Array:
    """Large strings without nulls; a copy where texts is a slice, whose offsets pyarrow's ascii_lower misreads."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    return texts.take(pa.array(np.arange(len(texts)))) if texts.offset else texts


def word_parts(texts: pa.Array) -> pa.Array:
    """The pieces of each text for a word tokenizer that lowers case; full stops and commas after a letter stand alone."""
    if not pc.any(pc.match_substring(texts, "<|")).as_py():  # else lower case could spell a special token
        texts = pc.ascii_lower(texts)
    return pc.ascii_split_whitespace(pc.replace_substring_regex(texts, r"([a-z])([.,]+)([ \n])", r"\1 \2\3"))


class PieceEncoder:
    """Encodes columns of texts; kind is "word" or "byte" (see the module)."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        if kind not in ("word", "byte"):
            raise ValueError(f"unknown kind {kind!r}")
        self.kind = kind
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.mark = next((t.content for _, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)), None)
        self.mark_id = self.tokenizer.token_to_id(self.mark) if self.mark else -1
        self.reset()

    def reset(self) -> None:
        self.kept: dict[str, int] = {}
        self.chars = 0
        self.flat = np.zeros(0, np.uint32)
        self.begins = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.met = np.zeros(0, bool)

    def forget(self) -> None:
        """Keep what was met again since the last time, if that is less than half of what may be kept."""
        keep = np.flatnonzero(self.met)
        names = list(self.kept)
        names = [names[k] for k in keep.tolist()]
        chars = sum(map(len, names))
        if 2 * len(names) > KEPT or 2 * chars > KEPT_CHARS:
            self.reset()
            return
        each = self.sizes[keep]
        place = np.repeat(self.begins[keep] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        self.kept, self.chars = dict(zip(names, range(len(names)))), chars
        self.flat, self.sizes = self.flat[place], each
        self.begins, self.met = np.cumsum(each) - each, np.zeros(len(names), bool)

    @classmethod
    def of(cls, path: str, kind: str) -> "PieceEncoder":
        """One per worker process."""
        if (path, kind) not in _made:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            _made[path, kind] = cls(path, kind)
        return _made[path, kind]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, how many each has).

        Many pieces go to the library as one text with a special token between them, which it cuts out before it does anything else.
        """
        plain = [k for k, p in enumerate(pieces) if "<" not in p] if self.mark else []
        other = [k for k, p in enumerate(pieces) if "<" in p] if self.mark else range(len(pieces))
        groups = [plain[k : k + 256] for k in range(0, len(plain), 256)]
        texts = [self.mark.join([pieces[k] for k in g]) for g in groups] + [pieces[k] for k in other]
        encoded = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.zeros(len(pieces), np.int64)
        parts = []
        for g, ids in zip(groups, encoded):
            cuts = np.flatnonzero(ids == self.mark_id)
            sizes[g] = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
            parts.append(np.delete(ids, cuts))
        for k, ids in zip(other, encoded[len(groups) :]):
            sizes[k] = len(ids)
        if not len(other):
            return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), sizes
        order = [*plain, *other]
        flat = np.concatenate([*parts, *encoded[len(groups) :]])
        held = sizes[order]
        begins = np.empty(len(pieces), np.int64)
        begins[order] = np.cumsum(held) - held
        return flat[np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))], sizes

    def places(self, pieces: list[str]) -> np.ndarray:
        """Where the ids of each piece are kept; new ones are encoded."""
        if len(self.kept) + len(pieces) // 2 > KEPT or self.chars > KEPT_CHARS:
            self.forget()
        found = np.fromiter(map(self.kept.get, pieces, repeat(-1)), np.int64, len(pieces))
        at = np.flatnonzero(found < 0)
        self.met[found[found >= 0]] = True
        if len(at):
            new = [pieces[k] for k in at.tolist()]
            flat, sizes = self.encode_pieces(new)
            n = len(self.kept)
            self.kept.update(zip(new, range(n, n + len(new))))
            self.chars += sum(map(len, new))
            self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, flat])
            self.met = np.concatenate([self.met, np.zeros(len(new), bool)])
            found[at] = np.arange(n, n + len(new))
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text); a null text has none."""
        texts = whole(texts)
        if self.kind == "word":
            return self._gather(word_parts(texts))
        odd = pc.match_substring_regex(texts, _UNEVEN)
        if not pc.any(odd).as_py():
            return self._even(texts)
        odd = odd.to_numpy(zero_copy_only=False)
        even, even_n = self._even(texts.filter(pa.array(~odd)))
        cut = pa.array([_SAFE_BLANK.split(t) for t in texts.filter(pa.array(odd)).to_pylist()], pa.large_list(pa.large_string()))
        other, other_n = self._gather(cut)
        counts = np.zeros(len(texts), np.int64)
        counts[~odd], counts[odd] = even_n, other_n
        out = np.empty(int(counts.sum()), np.uint32)
        mask = np.repeat(odd, counts)
        out[~mask], out[mask] = even, other
        return out, counts

    def _even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.replace_substring_regex(texts, r"([a-z])([.,]+)([ \n])", "\\1\x00\\2\\3")
        cut = pc.replace_substring(pc.replace_substring(cut, " ", "\x00 "), "\n", "\x00\n\x00")
        return self._gather(pc.split_pattern(cut, "\x00"))

    def _gather(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = parts.flatten().dictionary_encode()
        at, offsets = coded.indices.to_numpy(zero_copy_only=False), parts.offsets.to_numpy()
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(parts), np.int64)
        kept = self.places(coded.dictionary.to_pylist())
        # The kept ids lie one piece after the other, so a list array views them, and Arrow copies each occurrence's ids in one go.
        ids = pa.LargeListArray.from_arrays(pa.array(np.append(self.begins, len(self.flat))), pa.array(self.flat)).take(pa.array(kept[at]))
        ends = np.asarray(ids.offsets)
        return ids.flatten().to_numpy(), np.diff((ends - ends[0])[offsets])
