"""Token ids of whole texts, as the tokenizers library gives them.

The library loads the file and settles what its ids are. Texts of characters that every Unicode version classes
alike (PLAIN) are then encoded by tiktoken's encoder over the same merges, which is some times faster: it always joins the
neighbours whose joint token came first. That is the library's result for every text if the library
itself finds each merged token whole in the token's own bytes: whatever joins inside a token's bytes joins in the same order
wherever these bytes stand, so both reach the token by its listed merge. This is checked for all tokens when
a file is loaded. If some token fails, and for other texts and texts with very long runs, the library encodes.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

import numpy as np

#: Letters, marks and digits of the Latin, Greek and Cyrillic scripts, and typographic marks, whose classes are the same in every version.
PLAIN = re.compile("[\\n -~¡-ſΑ-ΡΣ-ώА-я–—‘’“”„…€]*")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer matches than about this go to the library.
RUN = 20_000
LONG_SPACE = re.compile(rf"[ \n]{{{RUN}}}")


def byte_letters() -> dict[int, str]:
    """The printable stand-ins by which byte-level vocabularies spell bytes: printable bytes as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {x: chr(x) for x in plain} | {x: chr(256 + i) for i, x in enumerate(rest)}


class Ids:
    """``encode`` gives a text's ids as little-endian bytes of ``dtype``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.fast, self.table = self.ranked(json.loads(Path(path).read_text()))

    def ranked(self, file: dict) -> tuple:
        """The encoder by ranks and the id of each rank; None where it might differ from the library."""
        import tiktoken

        model, before = file["model"], file["pre_tokenizer"]
        byte_level = before and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        odd = any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if not byte_level or odd or file.get("normalizer") or model["type"] != "BPE":
            return None, None
        letters = byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        spelt = [*letters.values(), *("".join(m) for m in merges)]
        if len(set(spelt)) < len(spelt) or any(len(found := self.tokenizer.model.tokenize(x)) != 1 or found[0].value != x for x in spelt):
            return None, None
        back = {c: b for b, c in letters.items()}
        ranks = {bytes(back[c] for c in x): i for i, x in enumerate(spelt)}
        return tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), np.array([model["vocab"][x] for x in spelt], self.dtype)

    def plain(self, text: str) -> bool:
        return self.fast is not None and PLAIN.fullmatch(text) is not None and (len(text) <= RUN or (max(map(len, text.split()), default=0) < RUN and not LONG_SPACE.search(text)))

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, as bytes of ``dtype``."""
        if not text:
            return b""
        if self.plain(text):
            return self.table[self.fast.encode_ordinary(text)].tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()


_shared: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One vocabulary for each Python worker."""
    if path not in _shared:
        _shared[path] = Ids(path)
    return _shared[path]
