"""Token ids of whole texts, equal to those of the ``tokenizers`` library, but faster.

A byte-pair encoder first cuts a text into small pieces by a pattern and then merges each
piece alone.  The library spends most of its time on bookkeeping that ids do not need, so
plain text is cut and merged by ``tiktoken``, with ranks read from the tokenizer's own
file:

* Texts of code points up to U+024F (the two libraries' Unicode tables agree there) are
  plain.
* Every other text is split at single blanks between two non-space characters (neither
  tokenizer joins anything across those); its plain parts are treated as above, and the
  library encodes the rest.
* Texts that may hold a special string, over-long pieces and tokenizers with any other
  cutting rule go to the library.

``tests/llm/test_encoders.py`` compares ids with the library's on generated texts.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

from .common import worker_threads_off

#: Longer runs without a blank go to the library: tiktoken's merge is quadratic there.
LONG_PIECE_CHARS = 2048

PLAIN_TO = 0x24F
#: Characters outside the plain range, those that leave it in lower case, and the end mark.
_LEAVING = "".join(chr(c) for c in range(PLAIN_TO + 1) if any(ord(x) > PLAIN_TO for x in chr(c).lower()))
_NOT_PLAIN = re.compile(f"[^\x01-{chr(PLAIN_TO)}]|[{_LEAVING}]")
_BLANK_BY_SPACE = re.compile(r"\s | \s")
_SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")
_END = "\0"  # the end of a word while merging; no plain text holds it


def _class(major: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN_TO + 1) if unicodedata.category(chr(c))[0] == major)


# The contractions and the order of alternatives of the two public cutting patterns.
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_BLANK_LED = _SHORT + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTER, _NUMBER = _class("L"), _class("N")
_WORDS = re.compile(f"{_SHORT}|[{_LETTER}]+|[{_NUMBER}]|[^\\t-\\r \\x85\\xa0{_LETTER}{_NUMBER}]+")


def _byte_of_letter() -> dict[str, int]:
    """The letter a byte-level vocabulary writes for each byte: itself if printable, else the next from U+0100 on."""
    shown = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PieceEncoder:
    """``batch(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        worker_threads_off()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec.get("added_tokens") or []]
        self.mode = self._mode(spec)
        self.merger = self._merger(spec["model"]) if self.mode != "whole" else None

    @staticmethod
    def _mode(spec: dict) -> str:
        pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec["model"]
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges", "continuing_subword_prefix")):
            return "whole"
        if pre.get("type") == "ByteLevel" and not norm and not pre.get("add_prefix_space") and pre.get("use_regex", True):
            return "blank-led"
        steps = pre.get("pretokenizers", [])
        if [n.get("type") for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [s.get("type") for s in steps] == ["Split", "ByteLevel"]:
            if steps[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and steps[0]["invert"] and not steps[1]["use_regex"]:
                return "blank-dropped"
        return "whole"

    def _merger(self, model: dict):
        import tiktoken

        back, suffix = _byte_of_letter(), model.get("end_of_word_suffix") or ""
        ranks = {}
        for token, rank in model["vocab"].items():
            ends = bool(suffix) and token.endswith(suffix)
            letters = token[: len(token) - len(suffix)] if ends else token
            if token not in self.specials:
                ranks[bytes(back[c] for c in letters) + _END.encode() * ends] = rank
        return tiktoken.Encoding("own", pat_str=rf"[^{_END}]+{_END}" if suffix else _BLANK_LED, mergeable_ranks=ranks, special_tokens={})

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> bytes:
        if self.mode == "blank-dropped":
            words = _WORDS.findall(text.lower())
            text = _END.join(words) + _END * bool(words)
        return np.array(self.merger.encode_ordinary(text), dtype="<u4").tobytes()

    @staticmethod
    def _hard(text: str) -> bool:
        """Not plain, or perhaps with a run of LONG_PIECE_CHARS without a blank or of white space."""
        try:
            if "\0" in text or not text.isascii() and not text.encode("latin-1"):
                return True
        except UnicodeEncodeError:
            if _NOT_PLAIN.search(text):
                return True
        step = LONG_PIECE_CHARS // 2  # such a run covers one aligned step
        for at in range(0, len(text) - step + 1, step):
            if " " not in (part := text[at : at + step]) or part.isspace():
                return True
        return False

    def one(self, text: str) -> bytes:
        if self.mode == "whole" or "<|" in text or any(s in text for s in self.specials):
            return self._library([text])[0]
        if not self._hard(text):
            return self._plain(text)
        if _BLANK_BY_SPACE.search(text) or text[0] == " " or text[-1] == " ":
            parts = _SAFE_BLANK.split(text)
        else:
            parts = text.split(" ")
        if self.mode == "blank-led":
            parts[1:] = [" " + p for p in parts[1:]]
        hard = [i for i, p in enumerate(parts) if self._hard(p)]
        done = dict(zip(hard, self._library([parts[i] for i in hard])))
        return b"".join(done[i] if i in done else self._plain(p) for i, p in enumerate(parts))

    def batch(self, texts: list[str]) -> list[bytes]:
        return [self.one(t) for t in texts]


_loaded: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each file and worker process."""
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch, rows: int = 64, chars: int = 1 << 20):
    """Parts of an Arrow batch (id column, text column) with few rows and bounded text.

    A batch may hold 64 MB of text, so a text becomes a string only in its own part.
    """
    ids, texts = batch.column(0), batch.column(1)
    at, held, part = 0, 0, []
    for i in range(batch.num_rows):
        part.append(texts[i].as_py())
        held += len(part[-1])
        if len(part) >= rows or held >= chars:
            yield ids.slice(at, len(part)).to_pylist(), part
            at, held, part = i + 1, 0, []
    if part:
        yield ids.slice(at).to_pylist(), part
