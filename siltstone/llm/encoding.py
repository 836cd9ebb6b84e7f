"""Whole-text tokenization with a file of the tokenizers library, many texts at once.

Texts are cut into chunks at places that the tokenizer's own splitting always cuts, so that the ids of a text are the
ids of its chunks in a row. The distinct chunks of a batch are encoded once each and the ids of all texts gathered by
offsets. Which cuts are safe follows from the pre-tokenizer in the file:

* ``ByteLevel`` with its regular expression: a single space between two characters that are not white space begins
  a new piece, which keeps that space. Runs of white space are never cut.
* ``Split`` by the expression ``_KNOWN`` that removes white space, behind the normalizers ``_NORMAL``: spaces and line
  feeds never get into a piece.

Any other file is encoded text by text. A chunk of Latin letters, digits and signs is split here as those two
pre-tokenizers do, and the library's model of the file gets the distinct pieces, many in a row: the library's own
splitting takes twice the time of its model. All other chunks go through the whole tokenizer.

Nothing is kept from batch to batch but the tokenizer, so memory is that of a batch.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from .common import worker_state

_CUT = re.compile(r"(?<=\S) (?=\S)")
# The pattern of a ``Split`` and the normalizers before it, as tokenizer files have them.
_KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Letters and numbers below U+0250, where no code point is unassigned. U+0130 has a lower case of two characters.
_L, _N = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_SIMPLE = re.compile(r"[!-~\xa1-\xac\xae-\u012f\u0131-\u024f]+")
_SIMPLE_LINES = re.compile(r"[\n!-~\xa1-\xac\xae-\u012f\u0131-\u024f]+")
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^ \n{_L}{_N}]+|\n+(?![^\n])|\n+")
_PIECES_REMOVED = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}\u2c65\u2c66]+|[{_N}]|[^{_L}{_N}\u2c65\u2c66]+")
#: The same for RE2, and signs; a chunk of a line feed, letters and signs needs no search for its pieces.
_RE2_L = r"A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}"
_RE2_O = r"!-/:-@\[-`{-~\x{a1}-\x{a9}\x{ab}\x{ac}\x{ae}-\x{b1}\x{b4}\x{b6}-\x{b8}\x{bb}\x{bf}\x{d7}\x{f7}"
_WORD = rf"\A(?P<n>\n?)(?P<a>[{_RE2_L}]+)(?P<b>[{_RE2_O}]*)\z"
_INSIDE = re.compile(rf"[!-/:-@\[-`{{-~][{_L}]")
#: A space at an end or beside white space, in RE2's syntax.
_SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WIDE = rf"(?s)(\A|[{_SPACES}]) | (\z|[{_SPACES}])"


def _byte_letters() -> dict[int, str]:
    """What stands for each byte in a byte-level vocabulary: a printable Latin-1 character for itself, the others in
    order from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[0] : starts[0] + sizes[0]], flat[starts[1] : ...] and so on, in a row."""
    ends = np.cumsum(sizes)
    place = np.repeat(starts - (ends - sizes), sizes)
    place += np.arange(len(place))
    return flat[place]


class Encoder:
    """ids of whole texts, as the library's encode gives them without special tokens of its own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        apart = [(t.content, i) for i, t in added.items() if t.special and not (t.single_word or t.lstrip or t.rstrip or t.normalized)]
        self.mark = apart[-1] if apart else None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        pre, norm, model = file.get("pre_tokenizer") or {}, file.get("normalizer"), file["model"]
        steps = pre.get("pretokenizers", [pre])
        level = lambda s, regex: s.get("type") == "ByteLevel" and bool(s.get("use_regex")) == regex and not s.get("add_prefix_space")
        self.kind = "whole"
        if any(any(map(str.isspace, t)) for t in self.special) or any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
            pass
        elif len(steps) == 1 and level(steps[0], True) and norm is None:
            self.kind = "spaced"
        elif len(steps) == 2 and steps[0] == {"type": "Split", "pattern": {"Regex": _KNOWN}, "behavior": "Removed", "invert": True} and level(steps[1], False) and norm == {"type": "Sequence", "normalizers": _NORMAL}:
            self.kind = "removed"
        self.letters, self.end = _byte_letters(), model.get("end_of_word_suffix") or ""
        vocab = self.tokenizer.get_vocab()
        # what an id's token adds to the length of its row: its bytes, or 1 for the end of a piece
        self.measure = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        for t, i in vocab.items():
            self.measure[i] = t.endswith(self.end) if self.end else len(t)
        whole = all(c + e in vocab for c in self.letters.values() for e in {"", self.end})
        self.bare = None
        if self.kind != "whole" and model.get("type") == "BPE" and whole and not model.get("dropout") and not model.get("continuing_subword_prefix") and bool(self.end) == (self.kind == "removed"):
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = WhitespaceSplit()
        # no special token may hide in a chunk of letters and the signs behind them
        self.quick = self.bare is not None and all(_INSIDE.search(t) for t in self.special)
        self.letters[0] = "\0"  # between pieces; none has it

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts in a row, where each text's begin and the end); null is empty, and ``end_id`` follows
        each text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if self.kind == "whole":
            lists, plain = [[t] for t in texts.to_pylist()], np.zeros(len(texts), bool)
            words, firsts = pa.array([], pa.large_string()), np.empty(0, np.int64)
            index, bounds = np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        else:
            plain = np.ones(len(texts), bool) if self.kind == "removed" else ~pc.match_substring_regex(texts, _WIDE).to_numpy(zero_copy_only=False)
            lists = [_CUT.split(t) for t in texts.filter(pa.array(~plain)).to_pylist()]
            if lists:
                texts = pc.if_else(pa.array(plain), texts, "")
            # a run of line feeds begins a chunk of its own, too, which then has no space before it
            lined = pc.replace_substring(texts, "\n", " ") if self.kind == "removed" else pc.replace_substring_regex(texts, r"(\n+)", r" \1")
            cut = pc.split_pattern(lined, " ")
            bounds = cut.offsets.to_numpy().astype(np.int64)
            bounds -= bounds[0]
            flat = cut.flatten()
            firsts = bounds[:-1] if self.kind == "spaced" else np.empty(0, np.int64)
            coded = flat.dictionary_encode()
            index, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        # entries: the distinct words, behind a space in "spaced" files; then chunks as they are
        heads = flat.take(pa.array(firsts)).to_pylist() if len(firsts) else []
        own = list(dict.fromkeys([*heads, *(c if not k else " " + c for one in lists for k, c in enumerate(one))]))
        ids, starts, sizes = self._entries(words, own)
        place = {c: len(words) + i for i, c in enumerate(own)}
        if len(firsts):
            index[firsts] = [place[c] for c in heads]
        if lists:  # texts that were cut one by one take the place of their single empty word
            rows = np.flatnonzero(~plain)
            counts = np.diff(bounds)
            counts[rows] = [len(one) for one in lists]
            full = np.empty(int(counts.sum()), np.int64)
            new = np.concatenate([[0], np.cumsum(counts)])
            full[np.repeat(plain, counts)] = index[np.repeat(plain, np.diff(bounds))]
            full[np.repeat(~plain, counts)] = [place[c if not k else " " + c] for one in lists for k, c in enumerate(one)]
            index, bounds = full, new
        tokens = np.concatenate([[0], np.cumsum(sizes[index])])[bounds]
        out = gathered(ids, starts[index], sizes[index])
        if end_id is None:
            return out, tokens
        n = len(tokens) - 1
        ended = np.full(len(out) + n, end_id, np.uint32)
        rest = np.ones(len(ended), bool)
        rest[tokens[1:] + np.arange(n)] = False
        ended[rest] = out
        return ended, tokens + np.arange(n + 1)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        ids, at = self.encode(pa.array(texts, pa.large_string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]

    def _entries(self, words: pa.Array, own: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size): where the ids of each word and of each chunk of ``own`` lie."""
        n = len(words) + len(own)
        spaced, lead = self.kind == "spaced", " " if self.kind == "spaced" else ""
        pieces: dict[str, int] = {}
        piece = lambda p: pieces.setdefault(p, len(pieces))
        entry, which = [], []  # the pieces of the entries, in rows of one entry each
        quick = np.zeros(len(words), bool)
        if self.quick and len(words):
            found = pc.extract_regex(words, _WORD)
            quick = found.is_valid().to_numpy(zero_copy_only=False)
            fields = found.filter(pa.array(quick)).flatten()
            line, word, signs = fields
            lines, signed = (pc.not_equal(x, "").to_numpy(zero_copy_only=False) for x in (line, signs))
            if spaced:
                word = pc.if_else(pa.array(lines), word, pc.binary_join_element_wise(pa.scalar("", word.type), word, pa.scalar(" ", word.type)))
            else:
                word = pc.utf8_lower(word)
            known = pa.concat_arrays([word, signs.filter(pa.array(signed)), pa.array(["\n"], word.type)]).dictionary_encode()
            pieces = dict(zip(known.dictionary.to_pylist(), range(len(known.dictionary)), strict=True))
            at, m = known.indices.to_numpy(), len(word)
            rows = np.flatnonzero(quick)
            parts = np.full((m, 3), -1, np.int64)
            parts[lines & spaced, 0], parts[:, 1], parts[signed, 2] = at[-1], at[:m], at[m:-1]
            entry.append(np.repeat(rows, (parts >= 0).sum(1)))
            which.append(parts[parts >= 0])
        slow = np.flatnonzero(~quick)
        simple, split = (_SIMPLE_LINES, _PIECES) if spaced else (_SIMPLE, _PIECES_REMOVED)
        other: list[tuple[int, str]] = []
        for i, c in [*zip(slow.tolist(), (w if not w or w[0] == "\n" else lead + w for w in words.take(pa.array(slow)).to_pylist()), strict=True), *enumerate(own, len(words))]:
            if not c:
                continue
            if self.bare is None or c[:2] == " \n" or not simple.fullmatch(c, c[0] == " ") or any(x in c for x in self.special):
                other.append((i, c))
                continue
            parts = [piece(p) for p in split.findall(c if spaced else c.lower())]
            entry.append(np.full(len(parts), i))
            which.append(np.array(parts, np.int64))
        ids, ends = self._bare(list(pieces))
        begins, starts, sizes = np.concatenate([[0], ends[:-1]]).astype(np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        if sum(map(len, entry)):
            entry, which = np.concatenate(entry), np.concatenate(which)
            lengths = ends[which] - begins[which]
            sizes += np.bincount(entry, lengths, n).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
            starts[entry[first]] = (np.cumsum(lengths) - lengths)[first]
            ids = gathered(ids, begins[which], lengths)
        if other:
            parts = self._library([c for _, c in other])
            at = np.cumsum([len(ids), *map(len, parts)])
            rows = [i for i, _ in other]
            starts[rows], sizes[rows] = at[:-1], np.diff(at)
            ids = np.concatenate([ids, *parts])
        return ids, starts, sizes

    def _bare(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The model's ids of the pieces in a row, and where each piece's end: by what the ids add up to."""
        if not pieces:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        mapped = "\0".join(pieces).encode().decode("latin-1").translate(self.letters).split("\0")
        rows = [" ".join(mapped[at : at + 256]) for at in range(0, len(mapped), 256)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for at in range(0, len(rows), 64) for e in self.bare.encode_batch_fast(rows[at : at + 64], add_special_tokens=False)])
        sums = np.cumsum(self.measure[ids])
        goal = np.arange(1, len(mapped) + 1) if self.end else np.cumsum(list(map(len, mapped)))
        if not len(sums) or sums[-1] != goal[-1]:
            raise ValueError("the tokenizer's model left out a part of a piece")
        return ids, np.searchsorted(sums, goal) + 1

    def _library(self, chunks: list[str]) -> list[np.ndarray]:
        """Through the whole tokenizer, with a special token between chunks, which the library never merges with others."""
        out = [np.empty(0, np.uint32)] * len(chunks)
        apart = [i for i, c in enumerate(chunks) if self.mark is None or self.kind == "whole" or any(x in c for x in self.special)]
        for at in range(0, len(apart), 64):
            part = apart[at : at + 64]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([chunks[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, np.uint32)
        held = set(apart)
        joined = [i for i in range(len(chunks)) if i not in held]
        for at in range(0, len(joined), 64):
            part = joined[at : at + 64]
            ids = np.array(self.tokenizer.encode(self.mark[0].join(chunks[i] for i in part), add_special_tokens=False).ids, np.uint32)
            for i, found in zip(part, np.split(ids, np.flatnonzero(ids == self.mark[1])), strict=True):
                out[i] = found if i == part[0] else found[1:]
        return out


def encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    return worker_state(f"encoder {path}", lambda: Encoder(path))
