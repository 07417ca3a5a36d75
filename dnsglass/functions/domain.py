"""Column functions over domain names (all JVM-side built-ins, no UDF).

Every function takes and returns `Column`s so it composes into any projection,
stays inside whole-stage codegen and works identically in batch and streams.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DOMAIN_PATTERN, MAX_DOMAIN_LEN

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference): character sets of the lexical step
# ---------------------------------------------------------------------------
CONSONANTS = "bcdfghjklmnpqrstvwxyz"
VOWELS = "aeiou"
# Longest-run patterns over the whole domain; (?U) gives Python's Unicode \d \s \W
RUN_PATTERNS = {
    "LCc": r"(?U)[^aeiou\d\s\W]+",
    "LCn": r"(?U)\d+",
    "LCv": r"(?U)[aeiou]+",
}
LEXICAL_KEYS = ["N", "LCc", "LCv", "LCn",
                "L_tld", "Rc_tld", "Rv_tld", "Rn_tld", "Rl_tld", "Rs_tld",
                "L_sld", "Rc_sld", "Rv_sld", "Rn_sld", "Rl_sld", "Rs_sld",
                "L_sub", "Rc_sub", "Rv_sub", "Rn_sub", "Rl_sub", "Rs_sub"]
ENTROPY_KEYS = ["entropy_full", "entropy_sld", "char_class_entropy", "unique_char_ratio"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- FLT-2 / FLT-3 / FLT-4 ---------------------------------------------------

def normalize_domain(col) -> Column:
    return F.lower(F.trim(_c(col)))


def is_valid_domain(col) -> Column:
    """Non-empty, <= 253 characters and matching the allowed character pattern."""
    d = _c(col)
    return ((F.length(d) > 0) & (F.length(d) <= MAX_DOMAIN_LEN)
            & d.rlike(DOMAIN_PATTERN))


def labels(col) -> Column:
    return F.split(_c(col), r"\.", -1)


def _split_parts(d: Column) -> tuple[Column, Column, Column]:
    """(subdomain, sld, tld) as three plain expressions (no shared struct)."""
    return split_parts(F.split(d, r"\.", -1))


def split_parts(parts: Column) -> tuple[Column, Column, Column]:
    """(subdomain, sld, tld) from the array of a domain's labels."""
    n = F.size(parts)
    tld = F.when(n >= 2, F.element_at(parts, -1)).otherwise(F.lit(""))
    sld = F.when(n >= 2, F.element_at(parts, -2)).otherwise(F.element_at(parts, 1))
    sub = F.when(n >= 3, F.array_join(F.slice(parts, 1, n - 2), ".")).otherwise(F.lit(""))
    return sub, sld, tld


def split_domain(col) -> Column:
    """struct(subdomain, sld, tld): tld = last label, sld = second last, rest joined.

    One label -> sld = label, tld = ''.  Subdomain only with >= 3 labels."""
    sub, sld, tld = _split_parts(_c(col))
    return F.struct(sub.alias("subdomain"), sld.alias("sld"), tld.alias("tld"))


def registered_domain(col) -> Column:
    """Last two labels (no public-suffix logic); the domain itself when shorter."""
    return F.substring_index(_c(col), ".", -2)


def first_label(col) -> Column:
    return F.substring_index(_c(col), ".", 1)


# --- SCA-1 .. SCA-4 -----------------------------------------------------------

def _chars(s: Column) -> Column:
    return F.split(s, "")


def shannon_entropy(col, base: float = 2.0) -> Column:
    """-sum p*log_b(p) over the characters of the string; '' -> 0.
    Per distinct character the count is len(s) - len(s without it), a native
    string operation, so the work per row is linear in the distinct characters."""
    s = _c(col)
    n = F.length(s).cast("double")
    ln_b = math.log(base)
    h = F.aggregate(F.array_distinct(_chars(s)), F.lit(0.0),
                    lambda acc, ch: acc - _plogp((n - F.length(F.replace(s, ch, F.lit("")))) / n) / F.lit(ln_b))
    return F.when(F.coalesce(F.length(s), F.lit(0)) == 0, F.lit(0.0)).otherwise(h)


def _plogp(p: Column) -> Column:
    return p * F.log(p)


def _class_count(s: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(s, pattern, "")).cast("double")


def char_class_entropy(col) -> Column:
    """Entropy over the three classes letter / digit / other."""
    s = _c(col)
    n = F.length(s).cast("double")
    h = F.lit(0.0)
    for c in (_class_count(s, r"[^\p{L}]"), _class_count(s, r"[^\p{Nd}]"),
              n - _class_count(s, r"[^\p{L}\p{Nd}]")):
        h = h - F.when(c > 0, (c / n) * F.log2(c / n)).otherwise(F.lit(0.0))
    return F.when(F.coalesce(F.length(s), F.lit(0)) == 0, F.lit(0.0)).otherwise(h)


def _unique_chars(s: Column) -> Column:
    return F.when(F.length(s) == 0, 0).otherwise(F.size(F.array_distinct(_chars(s))))


def unique_char_ratio(col) -> Column:
    s = _c(col)
    return _unique_chars(s).cast("double") / F.greatest(F.length(s), F.lit(1))


def entropy_feature_list(col, parts=None) -> list[tuple[str, Column]]:
    """The 4 named entropy features; `parts`: (subdomain, sld, tld) where they are columns already."""
    d = _c(col)
    _, sld, _ = parts or _split_parts(d)
    return [("entropy_full", shannon_entropy(d)), ("entropy_sld", shannon_entropy(sld)),
            ("char_class_entropy", char_class_entropy(sld)), ("unique_char_ratio", unique_char_ratio(sld))]


def entropy_features(col) -> Column:
    return F.struct(*[c.alias(k) for k, c in entropy_feature_list(col)])


# --- SCA-5 .. SCA-7 -----------------------------------------------------------

def char_ratio_list(col, suffix: str = "") -> list[tuple[str, Column]]:
    """(L, Rc, Rv, Rn, Rl, Rs) of one string; '' -> all zeros."""
    s = _c(col)
    n = F.length(s).cast("double")

    def ratio(cnt: Column) -> Column:
        return F.when(n == 0, F.lit(0.0)).otherwise(cnt / n)

    return [(f"L{suffix}", n),
            (f"Rc{suffix}", ratio(_class_count(s, f"[^{CONSONANTS}]"))),
            (f"Rv{suffix}", ratio(_class_count(s, f"[^{VOWELS}]"))),
            (f"Rn{suffix}", ratio(_class_count(s, r"[^\p{Nd}]"))),
            (f"Rl{suffix}", ratio(_class_count(s, r"[^\p{L}]"))),
            (f"Rs{suffix}", ratio(n - _class_count(s, r"[^\p{L}\p{N}]")))]


def char_ratios(col, suffix: str = "") -> Column:
    return F.struct(*[c.alias(k) for k, c in char_ratio_list(col, suffix)])


def longest_run(col, pattern: str) -> Column:
    runs = F.regexp_extract_all(_c(col), F.lit(pattern), 0)
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0)).cast("double")


def lexical_feature_list(col, parts=None) -> list[tuple[str, Column]]:
    """The 22 named lexical features as (name, Column) pairs; `parts` as above."""
    d = _c(col)
    sub, sld, tld = parts or _split_parts(d)
    has_sub = sub != ""
    out = [("N", F.when(has_sub, 3.0).otherwise(2.0))]
    out += [(k, longest_run(d, RUN_PATTERNS[k])) for k in ("LCc", "LCv", "LCn")]
    out += char_ratio_list(tld, "_tld") + char_ratio_list(sld, "_sld")
    out += [(k, F.when(has_sub, c).otherwise(F.lit(0.0))) for k, c in char_ratio_list(sub, "_sub")]
    return out


def lexical_features(col) -> Column:
    """The 22 named lexical features as a struct of doubles."""
    return F.struct(*[c.alias(k) for k, c in lexical_feature_list(col)])


def pairs_to_map(pairs: list[tuple[str, Column]]) -> Column:
    return F.create_map(*[x for k, c in pairs for x in (F.lit(k), c.cast("double"))])


EXTRACTORS = {
    "lexical": lexical_feature_list,
    "entropy": entropy_feature_list,
}


def feature_map(col, extractors=("lexical", "entropy"), parts=None) -> Column:
    """SCA-8: selected extractor groups merged into one map; empty domain -> {}.
    Built from flat (name, Column) pairs so every feature expression appears
    once in the plan."""
    d = _c(col)
    pairs = [p for e in extractors for p in EXTRACTORS[e](d, parts)]
    empty = F.create_map().cast("map<string,double>")
    return F.when(F.coalesce(F.length(d), F.lit(0)) == 0, empty).otherwise(pairs_to_map(pairs))


# --- SCA-9 .. SCA-15 ------------------------------------------------------------

def ratio_extractors(col) -> Column:
    """digit / vowel / consonant ratios of the first label (letters that are
    not a, e, i, o, u in either case count as consonants)."""
    s = first_label(col)
    n = F.greatest(F.length(s), F.lit(1)).cast("double")
    vowels = _class_count(s, r"[^aeiouAEIOU]")
    return F.struct(
        (_class_count(s, r"[^\p{Nd}]") / n).alias("digit_ratio"),
        (vowels / n).alias("vowel_ratio"),
        ((_class_count(s, r"[^\p{L}]") - vowels) / n).alias("consonant_ratio"),
    )


def risk_band(score) -> Column:
    s = _c(score)
    return F.when(s >= 0.8, "high").when(s >= 0.5, "medium").otherwise("low")


def ab_ratio(col) -> Column:
    """First 8 hex digits of md5 as an unsigned int over 0xFFFFFFFF."""
    return F.conv(F.substring(F.md5(_c(col)), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def cache_key(col) -> Column:
    return F.concat(F.lit("score:"), F.substring(F.sha2(_c(col), 256), 1, 16))


def model_version_tag(binary, family) -> Column:
    return F.concat_ws("+", _c(binary), _c(family))
