"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker."""

from __future__ import annotations

import json
import os
import re
from array import array

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism

from tokenizers import Tokenizer  # noqa: E402

#: Words of one generation that a worker remembers (about 200 bytes each); it keeps two generations.
REMEMBERED = 250_000
#: White space other than what str.split takes care of in the "dropped" kind: such texts are encoded whole.
_ODD_SPACE = re.compile(r"[^\S \n\t\r\f\v]")
#: A word of Latin letters that are their own NFC, with ASCII signs after it: at most one token run each.
_SIMPLE = re.compile(r"(\n?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


def _byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it in byte-level vocabularies: printable ones are themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def _kind(path: str) -> str:
    """How white space enters the ids: 'spaced' (a blank belongs to the next word), 'dropped', else 'whole'."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None:
        return "spaced"
    steps = [x.get("type") for x in (norm or {}).get("normalizers", [])]
    first = (pre.get("pretokenizers") or [{}])[0]
    if steps == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"\s" in str(first.get("pattern")):
        return "dropped"
    return "whole"


class WordTokenizer:
    """encode(texts): the ids of each text as little-endian unsigned 32-bit integers.

    The ids are those of the library's encode of the whole text without special tokens (strings that
    look like one are ordinary text). Neither kind of tokenizer lets a token cross the blank before a
    word, so a text is split there and each distinct word is encoded once.
    """

    def __init__(self, path: str):
        self.kind = _kind(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, run: str) -> bytes:
        """Ids of a run that the pre-tokenizer leaves in one piece: the library's model alone sees it."""
        if self.kind == "dropped":
            run = run.lower()
        if run.isascii() and run[0] >= " ":  # visible signs stand for themselves
            mapped = self.letters[32] + run[1:] if run[0] == " " else run
        else:
            mapped = run.encode().decode("latin1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(mapped)]).tobytes()

    def _run(self, run: str) -> bytes:
        if run not in self.runs:
            self.runs[run] = self._model(run)
        return self.runs[run]

    def _parts(self, text: str) -> list[str] | None:
        """Keys of the words: as they stand after a blank; marked by \\0 at the start of the text.

        None where splitting at blanks could change the ids.
        """
        words = text.split()
        if self.kind == "dropped":
            return None if _ODD_SPACE.search(text) else words
        gaps = len(words) - 1
        if self.kind == "whole" or gaps < 0 or "\0" in text or text.count(" ") + text.count("\n") != gaps or len("".join(words)) != len(text) - gaps:
            return None  # not single blanks and line ends only
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = "\0" + parts[0]
        return parts

    def _learn(self, keys: list[str]) -> None:
        others = []
        for k in keys:
            if k in self.before:
                self.known[k] = self.before[k]
                continue
            first = self.kind == "spaced" and k[:1] == "\0"
            m = _SIMPLE(k[1:] if first else k)
            if not m or self.kind == "whole":
                others.append(k)
            elif self.kind == "spaced" and (m[1] or first):
                self.known[k] = b"".join([self._run(r) for r in m.groups() if r])
            else:
                letters = m[2]
                if letters not in self.known:
                    self.known[letters] = self.before.get(letters) or self._model(" " + letters if self.kind == "spaced" else letters)
                if m[3] or m[1]:
                    self.known[k] = self.known[letters] + (self._run(m[3]) if m[3] else b"")
        if others:
            self.known.update(zip(others, self._ids([self._as_text(k) for k in others])))

    def _as_text(self, key: str) -> str:
        if self.kind == "dropped" or key[:1] == "\n":
            return key
        return key[1:] if key[:1] == "\0" else " " + key

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if len(self.known) + len(self.runs) > REMEMBERED:
                self.known, self.before, self.runs = {}, self.known, {}
            get = self.known.get
            parts = self._parts(text)
            if parts is None:
                out.append(self._ids([text])[0])
                continue
            ids = list(map(get, parts))
            if None in ids:
                self._learn(list({p for p, x in zip(parts, ids) if x is None}))
                ids = list(map(get, parts))
            out.append(b"".join(ids))
        return out


_loaded: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """This worker's tokenizer of a file; a worker that is used again has it already."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]
