"""Token ids under a vocabulary whose pre-tokenizer drops white space: unit by unit."""

from __future__ import annotations

import functools
import json
import os
from array import array

import numpy as np

#: Units remembered by a task at most; the first ones met are the frequent ones.
REMEMBERED = 300_000
#: Mark of a word's last symbol in the vocabulary file.
END = "</w>"
#: Code points from here on stand for the vocabulary's basic symbols: byte b is BASE + b, or BASE + 256 + b at a word's end.
BASE = 0x100


class WordTokens(dict):
    """unit -> its packed ids (little-endian unsigned 32-bit).

    White space separates units and is dropped, so a text's ids are those of its units in a row.
    Units of Latin-1 characters are merged by rank, many in one call: each byte, and each byte
    that ends a word, is one symbol, and a symbol is one character of two bytes, merged first.
    All others, and those with a special token's string, go to the public library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        from tessella.llm.bpe import byte_alphabet

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.word = regex.compile(steps[0]["pattern"]["Regex"] + "| ")
        back = {c: chr(BASE + b) for c, b in byte_alphabet().items()}

        def symbols(token: str) -> bytes:
            body, end = (token[: -len(END)], 256) if token.endswith(END) else (token, 0)
            s = "".join(back[c] for c in body)
            return (s[:-1] + chr(ord(s[-1]) + end)).encode()

        special = set(self.specials)
        ids = {symbols(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merged = [symbols((a + b) if isinstance(m, list) else m.replace(" ", "")) for m in spec["model"]["merges"] for a, b in [m if isinstance(m, list) else (m, "")]]
        order = [bytes([b]) for b in range(256)] + [chr(BASE + s).encode() for s in range(512)] + merged
        self.of_rank = np.zeros(len(order), "<u4")
        for rank, b in enumerate(order):
            self.of_rank[rank] = ids.get(b, 0)
        self.space = 32
        self.ranks = tiktoken.Encoding("symbols", pat_str=r"\S+|\s", mergeable_ranks={b: r for r, b in enumerate(order)}, special_tokens={})

    @staticmethod
    def units(text: str) -> list[str]:
        gaps = not any(c in text for c in "\x1c\x1d\x1e\x1f")  # white space to split(), not to the vocabulary
        if not gaps:
            return [text]
        if "<|" in text:
            return text.split()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        return text.lower().split()  # as the vocabulary does it, character by character

    def merge(self, units: list[str]) -> list[bytes]:
        """Ids of lower-case Latin-1 units, in one call; tabs part words, spaces part units."""
        words = self.word.findall(" ".join(units) + " ")
        b = np.frombuffer("\t".join(words).encode(), np.uint8)
        gap = (b == 9) | (b == 32)
        symbols = b.astype("<u2") + (BASE + 256 * np.r_[gap[1:], True]).astype("<u2")
        symbols[gap] = b[gap]
        ranks = np.array(self.ranks.encode_ordinary(symbols.tobytes().decode("utf-16-le")), np.int64)
        ranks = ranks[ranks != 9]
        ends = np.flatnonzero(ranks == self.space)
        data = self.of_rank[ranks].tobytes()
        starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
        return [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]

    def new(self, units: list[str]) -> dict[str, bytes]:
        easy, hard = [], []
        for u in units:
            (easy if self._easy(u) else hard).append(u)
        made = dict(zip(easy, self.merge(easy))) if easy else {}
        made.update((u, array("I", e.ids).tobytes()) for u, e in zip(hard, self.library.encode_batch(hard, add_special_tokens=False)))
        return made

    @staticmethod
    def _easy(u: str) -> bool:
        return "<|" not in u and u.isprintable() and (u.isascii() or max(u) < "\u0100") and u == u.lower()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        known, met, rows = self.get, set(), []
        for x in texts:
            units = self.units(x) if x else []
            parts = list(map(known, units))
            gaps = [i for i, p in enumerate(parts) if p is None]
            met.update([units[i] for i in gaps])
            rows.append((parts, gaps, [units[i] for i in gaps]))
        made = self.new(list(met))
        out = []
        for parts, gaps, units in rows:
            for i, u in zip(gaps, units):
                parts[i] = made[u]
            out.append(b"".join(parts))
        room = REMEMBERED - len(self)
        if room > 0:
            self.update([x for x in made.items() if len(x[0]) < 40][:room])
        return out


@functools.lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)
