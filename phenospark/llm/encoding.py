"""Token ids of whole texts by the ``tokenizers`` library, with a bounded cache
of pieces.

Both public vocabularies merge inside pre-tokens only, so a text may be cut
wherever two pre-tokens always meet and its ids are those of its pieces in a
row.  Pieces repeat, texts seldom do: only pieces not seen before go through the
library.  Texts of plain Latin characters are cut into pre-tokens, which go
straight to the library's model; others are cut at spaces, and where even such a
cut could change ids the whole text goes through.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable

#: Bound of the cache of a Python worker (about 200 bytes an entry).
CACHE_ENTRIES = 1_000_000

_SPACED = re.compile(r" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_PUNCTUATION = "¡¿«»“”‘’–—…€£"
#: Plain texts: classes, lower case and normal form of these characters are the same everywhere.
_PLAIN = re.compile(rf"[\n -~À-ÖØ-öø-ÿ{_PUNCTUATION}]*")
#: The two vocabularies' pre-tokens, over plain texts (fixed patterns).
_WORD_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \na-z0-9ß-öø-ÿ]+")
_SPACED_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ \nA-Za-z0-9À-ÖØ-öø-ÿ]+|[ \n]+(?![^ \n])|[ \n]+")
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, int]:
    """Byte -> the letter that stands for it in byte-level vocabularies: visible
    bytes are themselves, the others follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 256 + i for i, b in enumerate(rest)}


_LETTERS = _byte_letters()

_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """``ids(texts)``: for each text the bytes of its ids, little-endian unsigned
    32-bit, as ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bound = cache_entries
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        self.special = [t["content"] for t in added]
        plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t["content"].split() != [t["content"]]
                        for t in added)
        pre = spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers") or [pre]
        # White space is dropped by the split itself: any space ends a piece.
        self.drops_space = plain and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" \
            and bool(steps[0].get("invert")) and "\\s" in str(steps[0].get("pattern"))
        # A space belongs to the word behind it; runs of spaces are cut before the last one.
        self.leads_space = plain and len(steps) == 1 and steps[0].get("type") == "ByteLevel" \
            and steps[0].get("use_regex", True) and not steps[0].get("add_prefix_space") and not spec.get("normalizer")
        # White space is dropped by the vocabulary's own split, after lower-casing, in byte letters.
        self.tokens = _WORD_TOKENS if self.drops_space and steps[0]["pattern"].get("Regex") == _WORD_PATTERN \
            and [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] \
            and len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex", True) else \
            _SPACED_TOKENS if self.leads_space else None
        self.cache: dict[str, bytes] = {}

    def pieces(self, text: str) -> tuple[list[str], bool]:
        """Pieces in a row, and whether they are pre-tokens of a plain text."""
        special = any(s in text for s in self.special)
        if self.tokens and not special and _PLAIN.fullmatch(text):
            return self.tokens.findall(text.lower() if self.drops_space else text), True
        if self.drops_space:
            return text.replace("\n", " ").split(" "), False
        if self.leads_space and not special and not _OTHER_SPACE.search(text):
            return _SPACED.findall(text), False
        return [text], False

    def _pre_token(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(_LETTERS)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def ids(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of a batch: one look-up a piece, one library call for all pieces
        that the cache lacks."""
        get = self.cache.get
        cuts = [self.pieces(t) for t in texts]
        found = [list(map(get, cut)) for cut, _ in cuts]
        lacking = [(cut, got, [i for i, v in enumerate(got) if v is None], plain)
                   for (cut, plain), got in zip(cuts, found, strict=True) if None in got]
        if lacking:
            made = {p: self._pre_token(p) for p in {cut[i] for cut, _, at, plain in lacking if plain for i in at}}
            new = list({cut[i] for cut, _, at, plain in lacking if not plain for i in at} - made.keys())
            made |= {p: array("I", e.ids).tobytes() for p, e in
                     zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True)}
            for cut, got, at, _ in lacking:
                for i in at:
                    got[i] = made[cut[i]]
            if len(self.cache) + len(made) > self.bound:
                self.cache.clear()
            self.cache.update((p, v) for p, v in made.items() if len(p) <= 64)
        return [b"".join(got) for got in found]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; kept between tasks."""
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
