"""Tokens of a text, word by word, where a byte-level tokenizer's own split allows it.

A *word* is a run of anything but white space with the white space before it.  A byte-level
tokenizer with the usual pattern never lets a token cross from other characters into white
space, so the tokens of a text are those of its words one after another, and a word
needs to be encoded once only.  The rule is read from the tokenizer's file; a file
that does not fit it has its texts encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import islice

import numpy as np

#: Words that a worker remembers; when full, the earliest half (mostly frequent words) stays.
KEPT_WORDS = 300_000
#: Words that are encoded in one call.
JOINED = 512
_ODD = re.compile(r"\s(?:\s|\Z)|\A\s")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def blank_split(text: str) -> list[str]:
    """Words of ``text`` if all its white space is single blanks and line feeds: without the blank, but with the line feed, before them."""
    return text.replace("\n", " \n").split(" ")


def is_simple(text: str) -> bool:
    """Whether ``blank_split`` gives words: no white space at the ends, none next to other white space."""
    return text != "" and _ODD.search(text) is None


def is_plain(word: str) -> bool:
    """Whether a string is a word as ``blank_split`` gives it: no blanks, and no white space at its ends but one line feed before it."""
    core = word[1:] if word[:1] == "\n" else word
    return core != "" and core == core.strip() and " " not in core and "\n" not in core


def runs(text: str) -> list[str]:
    """Words of any text, each with the white space before it: cut where a blank or line feed follows something else.

    White space at the end goes with the last word.
    """
    found = _CUT.split(text) if text else []
    if len(found) > 1 and not found[-1].strip():
        found[-2:] = [found[-2] + found[-1]]
    return found


def visible_bytes() -> list[str]:
    """The character by which a byte-level vocabulary shows each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


#: Fixed value: the split that a byte-level pre-tokenizer makes.
LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def by_rank(made: dict):
    """The same merges as ranks for ``tiktoken``, which encodes plain words faster; None unless ids rise with the merges."""
    model, shown = made["model"], {c: b for b, c in enumerate(visible_bytes())}
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    merged = [model["vocab"].get("".join(x if isinstance(x, list) else x.split(" "))) for x in model["merges"]]
    if not plain or None in merged or any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or not all(c in model["vocab"] for c in shown):
        return None
    import tiktoken

    own = {t: n for t, n in model["vocab"].items() if all(c in shown for c in t)}
    if len(own) != 256 + len(merged) or sorted(own.values()) != list(range(len(own))):
        own = {t: n for t, n in own.items() if n in set(merged) or len(t) == 1}
    ranks = {bytes(shown[c] for c in t): n for t, n in own.items()}
    return tiktoken.Encoding("level", pat_str=LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})


class ByteLevel:
    """A ``tokenizers`` file; ``special`` tells whether the strings of special tokens inside texts are those tokens."""

    def __init__(self, path: str, special: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = not special
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        split = made.get("pre_tokenizer") or {}
        self.by_word = (
            split.get("type") == "ByteLevel"
            and bool(split.get("use_regex"))
            and not split.get("add_prefix_space")
            and not made.get("normalizer")
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"]) for x in made.get("added_tokens", []))
        )
        # plain words hold no special tokens where their strings are text
        ranks = by_rank(made) if self.by_word and not special else None
        self.plain_ids = ranks.encode_ordinary if ranks else self.ids
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        shown = visible_bytes()
        opens = shown[0x20], shown[0x0A]
        self.starts = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, n in vocabulary.items():
            self.starts[n] = token.startswith(opens)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, how many each has) of plain words as ``blank_split`` gives them, each with its blank or line feed."""
        ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), JOINED):
            own = np.array(self.plain_ids("".join([w if w[0] == "\n" else " " + w for w in words[at : at + JOINED]])), np.int64)
            first = np.flatnonzero(self.starts[own])
            ids.append(own)
            counts.append(np.diff(first, append=len(own)))
        return np.concatenate(ids), np.concatenate(counts)


class TokenCounter:
    """Counts tokens of whole texts as the library of the file does: ``tokenizers`` for .json, ``sentencepiece`` for .model."""

    def __init__(self, path: str):
        self.words: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole, self.by_word = (lambda text: len(model.encode(text, num_threads=1))), False
        else:
            self.level = ByteLevel(path, special=True)
            self.whole, self.by_word = (lambda text: len(self.level.ids(text))), self.level.by_word

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return [self.whole(text) for text in texts]
        known, out = self.words, []
        split = [blank_split(text) for text in texts]
        firsts = [words.pop(0) for words in split]
        new = list(set().union(*split).difference(known))
        plain = [word for word in new if is_plain(word)]
        # a text with any other part is never counted by parts
        known.update(dict.fromkeys(new, -(1 << 40)))
        known.update(zip(plain, self.level.word_ids(plain)[1].tolist(), strict=True))
        for text, first, words in zip(texts, firsts, split, strict=True):
            n = sum(map(known.__getitem__, words))
            if n < 0 or first != first.strip():
                n = sum(len(self.level.ids(run)) for run in runs(text))
            elif first:
                n += len(self.level.ids(first))
            out.append(n)
        if len(known) > KEPT_WORDS:
            self.words = dict(islice(known.items(), KEPT_WORDS // 2))
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)
