"""The lexical and entropy features of `domain` for an Arrow batch of ASCII names at once.

The same numbers as `domain.lexical_features` and `domain.entropy_features`; a batch is one
array of bytes, so a feature is a difference of running counts and not a regular
expression a name.
"""

from __future__ import annotations

import numpy as np

from .domain import CONSONANTS, ENTROPY_KEYS, LEXICAL_KEYS, VOWELS

_CODES = np.arange(128)


def _is(chars: str) -> np.ndarray:
    return np.isin(_CODES, [ord(c) for c in chars])


_DIGIT = _is("0123456789")
_LETTER = ((_CODES | 32) >= ord("a")) & ((_CODES | 32) <= ord("z"))
_VOWEL, _CONSONANT = _is(VOWELS), _is(CONSONANTS)
#: What the patterns of `domain.RUN_PATTERNS` match, in the order of the features.
_RUNS = ((_LETTER | _is("_")) & ~_VOWEL, _VOWEL, _DIGIT)


def _longest(mask: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """The longest stretch of set places of each row."""
    out = np.zeros(rows)
    at = np.flatnonzero(mask)
    if len(at):
        first = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (owner[at][1:] != owner[at][:-1])])
        np.maximum.at(out, owner[at[first]], np.diff(np.r_[first, len(at)]))
    return out


def _entropy(raw: np.ndarray, owner: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Shannon entropy in bits, distinct characters) of each row; a row's characters are
    added up in the order in which they first occur."""
    key, first, count = np.unique(owner * 128 + raw, return_index=True, return_counts=True)
    order = np.argsort(first)
    row, p = key[order] // 128, count[order] / size[key[order] // 128]
    return np.bincount(row, -(p * np.log(p) / np.log(2.0)), len(size)) + 0.0, np.bincount(row, minlength=len(size))


def features(names: list[str]) -> np.ndarray:
    """Rows of LEXICAL_KEYS and ENTROPY_KEYS."""
    n = len(names)
    raw = np.frombuffer("".join(names).encode("ascii"), np.uint8).astype(np.int64)
    size = np.array([len(x) for x in names], np.int64)
    stop = np.cumsum(size)
    start = stop - size
    owner = np.repeat(np.arange(n), size)
    upto = {k: np.r_[0, np.cumsum(v[raw])] for k, v in (("c", _CONSONANT), ("v", _VOWEL), ("n", _DIGIT), ("l", _LETTER))}
    dots = np.flatnonzero(raw == ord("."))
    seen = np.searchsorted(dots, stop)
    many = seen - np.searchsorted(dots, start)
    padded = np.r_[0, 0, dots]
    last = np.where(many >= 1, padded[seen + 1], stop)
    before = np.where(many >= 2, padded[seen], start)
    parts = {"tld": (np.where(many >= 1, last + 1, stop), stop), "sld": (np.where(many >= 2, before + 1, start), last), "sub": (start, before)}
    out = {"N": np.where(before > start, 3.0, 2.0)} | {k: _longest(m[raw], owner, n) for k, m in zip(("LCc", "LCv", "LCn"), _RUNS)}
    for name, (lo, hi) in parts.items():
        long = (hi - lo).astype(np.float64)
        held = {k: (c[hi] - c[lo]).astype(np.float64) for k, c in upto.items()}
        held["s"] = long - held["l"] - held["n"]
        out[f"L_{name}"] = long
        for k, c in held.items():
            out[f"R{k}_{name}"] = c / np.maximum(long, 1)
        if name == "sld":
            classes = np.zeros(n)
            for c in (held["l"], held["n"], held["s"]):
                share = np.where(c > 0, c / np.maximum(long, 1), 1.0)
                classes -= share * (np.log(share) / np.log(2.0))
            out["char_class_entropy"] = classes + 0.0
            place = np.arange(len(raw))
            inside = (place >= lo[owner]) & (place < hi[owner])
            out["entropy_sld"], kinds = _entropy(raw[inside], owner[inside], hi - lo)
            out["unique_char_ratio"] = kinds / np.maximum(long, 1)
    out["entropy_full"] = _entropy(raw, owner, size)[0]
    return np.column_stack([out[k] for k in LEXICAL_KEYS + ENTROPY_KEYS]) if n else np.zeros((0, len(LEXICAL_KEYS + ENTROPY_KEYS)))
