"""Names and identities: normalization, similarity, and what the alias table knows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks, and the letters without them.
_MARKED = "áàäâãåÁÀÄÂÃÅéèëêÉÈËÊíìïîÍÌÏÎóòöôõÓÒÖÔÕúùüûÚÙÜÛñÑçÇýÿÝ"
_PLAIN = "aaaaaaAAAAAAeeeeEEEEiiiiIIIIoooooOOOOOuuuuUUUUnNcCyyY"


def fix_mojibake(s: Column) -> Column:
    """UTF-8 that was read as Latin-1, where that gives valid text; else unchanged."""
    repaired = F.try_validate_utf8(F.encode(s, "ISO-8859-1").cast("string"))
    only_latin = ~s.rlike(r"[^\u0000-ÿ]")
    return F.when(s.rlike("[ÃÂ]") & only_latin, F.coalesce(repaired, s)).otherwise(s)


def _plain(s: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(fix_mojibake(F.coalesce(s, F.lit(""))), _MARKED, _PLAIN), r"[̀-ͯ]", ""))


def norm(s: Column) -> Column:
    """Lower case, without marks, letters and digits only."""
    return F.regexp_replace(_plain(s), "[^a-z0-9]+", "")


def clean_text(s: Column) -> Column:
    return F.trim(F.translate(fix_mojibake(F.coalesce(s, F.lit(""))), " ", " "))


def name_tokens(s: Column) -> Column:
    """A name's words of two letters and more."""
    return F.filter(F.split(_plain(s), "[^a-z]+"), lambda t: F.length(t) >= 2)


def name_key(s: Column) -> Column:
    return F.array_join(name_tokens(s), " ")


def doc_of(s: Column) -> Column:
    """Of 11 digits the middle eight, of 7 or 8 all, without leading zeros; else empty."""
    d = F.regexp_replace(F.coalesce(s, F.lit("")), "[^0-9]", "")
    return F.when(F.length(d) == 11, F.regexp_replace(F.substring(d, 3, 8), "^0+", "")).when(F.length(d).between(7, 8), F.regexp_replace(d, "^0+", "")).otherwise("")


def cbu_of(s: Column) -> Column:
    """An account number of exactly 22 digits, else empty."""
    d = F.regexp_replace(F.coalesce(s, F.lit("")), "[^0-9]", "")
    return F.when(F.length(d) == 22, d).otherwise("")


def letter_runs(user: Column) -> Column:
    """The letter runs of a user name, and all of them joined if there are several."""
    runs = F.filter(F.split(F.lower(F.translate(F.coalesce(user, F.lit("")), _MARKED, _PLAIN)), "[^a-z]+"), lambda t: t != "")
    return F.when(F.size(runs) > 1, F.concat(runs, F.array(F.array_join(runs, "")))).otherwise(runs)


def name_hint(user: Column, holder: Column) -> Column:
    """Whether parts of the user name resemble a word of the holder's name."""

    def alike(run: Column, word: Column) -> Column:
        n, m = F.length(run), F.length(word)
        close = lambda k: F.levenshtein(run, F.substring(word, F.lit(1), k)) <= 1
        return (m >= 3) & (
            word.startswith(run) | run.startswith(word)
            | ((n >= 5) & F.contains(word, run))
            | ((n >= 5) & (close(n) | close(n + 1)))
            | ((m >= 5) & (n > m) & F.contains(run, word))
            | ((n == 4) & (m >= 5) & (F.levenshtein(run, F.substring(word, F.lit(1), F.lit(5))) == 1) & (F.substring(run, 1, 1) == F.substring(word, 1, 1)))
        )

    words = name_tokens(holder)
    return F.exists(F.filter(letter_runs(user), lambda r: F.length(r) >= 4), lambda r: F.exists(words, lambda w: alike(r, w)))


def same_name(a: Column, b: Column) -> Column:
    """Equal keys, or the shorter (two words, eight letters at least) begins the longer."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a == b) | ((F.size(F.split(short, " ")) >= 2) & (F.length(short) >= 8) & long.startswith(short))


def identity_keys(doc: Column, cbu: Column) -> Column:
    """The keys of a wallet row's document and account number."""
    return F.array_compact(F.array(F.when(doc != "", F.concat(F.lit("#"), doc)), F.when(cbu != "", F.concat(F.lit("#cbu"), cbu))))


def name_relation(known: Column, user: Column, holder: Column, doc: Column, cbu: Column) -> Column:
    """``known``, ``hint``, ``different`` or null, given the user's known identity keys (array)."""
    known = F.coalesce(known, F.array().cast("array<string>"))
    names = F.filter(known, lambda k: ~k.startswith("#"))
    key = name_key(holder)
    has_holder = F.coalesce(holder, F.lit("")) != ""
    hint = name_hint(user, holder)
    return (
        F.when(F.arrays_overlap(known, identity_keys(F.coalesce(doc, F.lit("")), F.coalesce(cbu, F.lit("")))), "known")
        .when(~has_holder, F.lit(None))
        .when((F.size(names) > 0) & F.exists(names, lambda k: same_name(k, key)), "known")
        .when(hint, "hint")
        .when(F.size(names) == 1, "different")
    )
