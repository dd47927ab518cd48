"""Person-name tokens and phonetic blocking keys as Column expressions.

Everything here stays in the JVM: a name becomes tokens, a token becomes a
Metaphone key and a consonant-skeleton key, and a nickname also carries the
keys of its canonical given name. No shuffle and no Python worker is needed,
so key building is a narrow projection whatever the table size.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMALIZER_VERSION = "n2"

# Name particles that carry no identity.
PARTICLES = (
    "al", "el", "bin", "ibn", "bint", "ben", "binti", "van", "von", "der", "den", "de",
    "del", "della", "di", "da", "dos", "das", "du", "la", "le", "mac", "st",
)

# Hypocoristic -> canonical given name.
NICKNAMES = {
    "bill": "william", "will": "william", "billy": "william",
    "bob": "robert", "rob": "robert", "bobby": "robert",
    "sasha": "aleksandr", "alex": "aleksandr", "alexander": "aleksandr",
    "kate": "katherine", "katie": "katherine", "kathy": "katherine", "catherine": "katherine",
    "dick": "richard", "rick": "richard", "rich": "richard",
    "peggy": "margaret", "maggie": "margaret", "meg": "margaret",
    "paco": "francisco", "pancho": "francisco",
    "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth",
    "beppe": "giuseppe", "pino": "giuseppe",
    "hans": "johannes", "jan": "johannes", "johann": "johannes",
    "jim": "james", "jimmy": "james",
    "mike": "michael", "mick": "michael",
    "tom": "thomas", "tommy": "thomas",
    "dave": "david", "davy": "david",
    "joe": "joseph", "jose": "joseph", "pepe": "joseph",
    "misha": "mikhail", "volodya": "vladimir", "dima": "dmitri", "kolya": "nikolai",
    "vanya": "ivan", "petya": "pyotr", "seryozha": "sergei",
}

# Romanization of the scripts the lists are written in.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z",
    "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "shch", "ъ": "\"", "ы": "y", "ь": "'", "э": "e", "ю": "yu", "я": "ya",
    "і": "i", "ї": "yi", "є": "ye", "ґ": "g", "ў": "w", "ј": "j", "љ": "lj", "њ": "nj",
    "ћ": "c", "ђ": "dj", "џ": "dz",
}
GREEK = {
    "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i",
    "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s",
    "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
}
ARABIC = {
    "ا": "a", "أ": "a", "إ": "a", "آ": "a", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "h",
    "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s", "ش": "sh", "ص": "s", "ض": "d",
    "ط": "t", "ظ": "z", "ع": "'", "غ": "gh", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m",
    "ن": "n", "ه": "h", "و": "w", "ي": "y", "ى": "a", "ة": "h", "ء": "'", "ئ": "y", "ؤ": "w",
    "پ": "p", "چ": "ch", "ژ": "zh", "گ": "g", "ک": "k", "ی": "y", "ـ": "",
}
LATIN_SPECIAL = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i",
    "ħ": "h", "ŋ": "ng", "ə": "e", "’": "'", "‘": "'", "–": "-", "—": "-",
}
# Hebrew letters, and letters whose Unicode name misleads about their sound.
HEBREW = {
    "א": "a", "ב": "b", "ג": "g", "ד": "d", "ה": "h", "ו": "v", "ז": "z", "ח": "ch", "ט": "t", "י": "y", "כ": "k", "ך": "k", "ל": "l",
    "מ": "m", "ם": "m", "נ": "n", "ן": "n", "ס": "s", "ע": "a", "פ": "p", "ף": "f", "צ": "ts", "ץ": "ts", "ק": "k", "ר": "r", "ש": "sh", "ת": "t",
}
SOUNDS = {"ո": "o", "ձ": "dz", "ծ": "ts", "ც": "ts", "ძ": "dz", "წ": "ts", "ხ": "kh", "խ": "kh", "ց": "ts", "ջ": "j", "ჯ": "j", "ン": "n", "ん": "n"}


def _named_letters() -> dict[str, str]:
    """Letters of scripts whose Unicode names spell their sound: kana and Indic syllables, Georgian, Armenian, Thai."""
    table = {}
    for low, high in ((0x3041, 0x3100), (0x0900, 0x0980), (0x0980, 0x0A00), (0x0B80, 0x0C00), (0x10D0, 0x10FB), (0x0561, 0x0587), (0x0E01, 0x0E4E)):
        for ch in map(chr, range(low, high)):
            words = unicodedata.name(ch, "").split()
            if "LETTER" in words[:-1] or "VOWEL" in words and "SIGN" in words[:-1] or "CHARACTER" in words[:-1]:
                sound = words[-1] if words[0] != "THAI" else words[2] if words[2] != "SARA" else words[3]
                if words[0] in ("GEORGIAN", "ARMENIAN", "THAI") and words[2] != "SARA":
                    # the name begins with the sound: its consonants, or a vowel
                    sound = re.match("[AEIOU]|[^AEIOU]+", sound)[0]
                table[ch] = sound.lower()
    return table | SOUNDS


def hangul(ch: Column) -> Column:
    """A Hangul syllable as initial, vowel and final, by the arithmetic of its code point; NULL for other characters."""
    initial = ["g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h"]
    vowel = ["a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i"]
    final = ["", "k", "k", "ks", "n", "nj", "n", "t", "l", "lk", "lm", "lp", "ls", "lt", "lp", "l", "m", "p", "ps", "t", "t", "ng", "t", "t", "k", "t", "p", "t"]
    at = F.ascii(ch) - 0xAC00

    def part(values: list[str], i: Column) -> Column:
        return F.element_at(literal_array(values), (i + 1).cast("int"))

    spelt = F.concat(part(initial, F.floor(at / 588)), part(vowel, F.pmod(F.floor(at / 28), F.lit(21))), part(final, F.pmod(at, F.lit(28))))
    return F.when(at.between(0, 11171), spelt)


@lru_cache(maxsize=1)
def _char_table() -> dict[str, str]:
    """One character -> ASCII, built from Unicode decompositions and letter names plus the script tables."""
    table: dict[str, str] = {}
    for code in list(range(0xC0, 0x250)) + list(range(0x1E00, 0x1F00)):
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if c.isascii() and c.isalpha())
        if base:
            table[ch] = base
    for source in (CYRILLIC, GREEK, ARABIC, LATIN_SPECIAL, HEBREW, _named_letters()):
        for ch, out in source.items():
            table[ch] = out
            if ch.upper() != ch and len(ch.upper()) == 1:
                table[ch.upper()] = out[:1].upper() + out[1:]
    for code in range(0x370, 0x400):  # accented Greek and Cyrillic fold through their base letter
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base in table:
            table.setdefault(chr(code), table[base])
    return table


@lru_cache(maxsize=1)
def _single_char_pair() -> tuple[str, str]:
    singles = {k: v for k, v in _char_table().items() if len(v) == 1}
    return "".join(singles), "".join(singles.values())


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(values: dict[str, str]) -> Column:
    """A constant map, parsed from one SQL text: far fewer JVM calls than a literal per entry."""
    return F.expr("map(" + ", ".join(sql_string(x) for kv in values.items() for x in kv) + ")")


def literal_array(values) -> Column:
    return F.expr("array(" + ", ".join(sql_string(v) for v in values) + ")")


def ascii_fold(c: Column) -> Column:
    """Transliterate to ASCII; plain-ASCII values skip the character pass."""
    source, target = _single_char_pair()
    multi = {k: v for k, v in _char_table().items() if len(v) != 1}
    plain = F.translate(F.regexp_replace(c, r"\p{M}+", ""), source, target)
    chars = F.transform(
        F.split(plain, ""), lambda ch: F.coalesce(F.try_element_at(literal_map(multi), ch), hangul(ch), ch)
    )
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.array_join(chars, "")).otherwise(c)


def name_tokens(c: Column) -> Column:
    """Ordered normalized tokens, particles removed; empty array for a blank name."""
    camel = F.regexp_replace(ascii_fold(F.coalesce(c, F.lit(""))), r"(?<=[a-z])(?=[A-Z])", " ")
    words = F.split(F.regexp_replace(F.lower(camel), r"[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda t: (t != "") & ~F.array_contains(literal_array(PARTICLES), t))


def skeleton(c: Column) -> Column:
    """Consonant skeleton with romanization folds; a leading vowel is kept."""
    t = F.replace(F.replace(F.replace(c, F.lit("ks"), F.lit("x")), F.lit("kh"), F.lit("h")),
                  F.lit("ph"), F.lit("f"))
    t = F.regexp_replace(F.translate(t, "yjqc", "iikk"), r"(.)\1+", "$1")
    return F.regexp_replace(t, r"(?<!^)[aeiou]", "")


def canonical_given(c: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(NICKNAMES), c), c)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def metaphone(c: Column) -> Column:
    """Metaphone code of a lower-case ``[a-z0-9]`` token, one emission per letter.

    Every rule looks only at the letter's neighbours, so the code is a
    ``transform`` over the letters.
    """
    silent_start = c.substr(1, 2).isin("kn", "gn", "pn", "wr", "ae")
    letters = F.split(F.when(silent_start, c.substr(F.lit(2), F.length(c))).otherwise(c), "")

    def around(word: Column) -> Column:
        def at(pos: Column) -> Column:
            return F.coalesce(F.get(word, pos), F.lit(""))

        codes = F.transform(word, lambda ch, i: let(
            F.struct(ch.alias("ch"), (i == 0).alias("first"), (i == 1).alias("second"), at(i - 1).alias("p1"),
                     at(i - 2).alias("p2"), at(i + 1).alias("n1"), at(i + 2).alias("n2")), _metaphone_letter))
        return F.upper(F.array_join(codes, ""))

    return let(letters, around)


def _metaphone_letter(x: Column) -> Column:
    """Code emitted for one letter given the two letters on either side."""
    ch, p1, p2, n1, n2, first = x["ch"], x["p1"], x["p2"], x["n1"], x["n2"], x["first"]

    def vowel(y: Column) -> Column:
        return y.isin("a", "e", "i", "o", "u")

    def front(y: Column) -> Column:
        return y.isin("e", "i", "y")

    eaten = (
        ((ch == "h") & p1.isin("c", "p", "s", "t"))
        | ((ch == "h") & (p1 == "g") & ~vowel(n1))
        | ((ch == "h") & (p1 == "w") & x["second"])
        | ((ch == "g") & (p1 == "d") & front(n1))
        | ((ch == "y") & (p1 == "c"))
        | ((ch == "y") & (p1 == "g") & (p2 == "d"))
    )
    sibilant = (n1 == "i") & n2.isin("o", "a")
    return (
        F.when((ch == n1) & (ch != "c"), "")
        .when(eaten, "")
        .when(vowel(ch), F.when(first, ch).otherwise(""))
        .when(ch.isin("f", "j", "l", "m", "n", "r"), ch)
        .when(ch == "b", F.when((p1 == "m") & (n1 == ""), "").otherwise("b"))
        .when(ch == "c",
              F.when(((n1 == "i") & (n2 == "a")) | (n1 == "h"), "x").when(front(n1), "s").otherwise("k"))
        .when(ch == "d", F.when((n1 == "g") & front(n2), "j").otherwise("t"))
        .when(ch == "g", F.when(front(n1), "j").when((n1 == "h") & ~vowel(n2), "").otherwise("k"))
        .when(ch == "h", F.when(first | vowel(n1) | ~vowel(p1), "h").otherwise(""))
        .when(ch == "k", F.when(first | (p1 != "c"), "k").otherwise(""))
        .when(ch == "p", F.when(n1 == "h", "f").otherwise("p"))
        .when(ch == "q", "k")
        .when(ch == "s", F.when((n1 == "h") | sibilant, "x").otherwise("s"))
        .when(ch == "t",
              F.when(sibilant, "x").when(n1 == "h", "0").when((n1 == "c") & (n2 == "h"), "").otherwise("t"))
        .when(ch == "v", "f")
        .when(ch == "w",
              F.when(first & (n1 == "h"), F.when(vowel(n2) | (n2 == ""), "w").otherwise(""))
              .when(vowel(n1) | (n1 == ""), "w").otherwise(""))
        .when(ch == "x",
              F.when(first, F.when((n1 == "h") | sibilant, "x").otherwise("s")).otherwise("ks"))
        .when(ch == "y", F.when(vowel(n1), "y").otherwise(""))
        .when(ch == "z", "s")
        .otherwise("")
    )


def token_keys(c: Column, phonetic: bool = True) -> Column:
    """Keys of one token; initials have none. ``phonetic=False`` keeps skeleton keys only."""
    def keys(t: Column) -> Column:
        sk = F.concat(F.lit("sk:"), skeleton(t))
        return F.array(sk, F.concat(F.lit("mp:"), metaphone(t))) if phonetic else F.array(sk)

    forms = F.array_distinct(F.array(c, canonical_given(c)))
    return F.when(F.length(c) < 2, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.flatten(F.transform(forms, keys))))


def key_groups(tokens: Column, phonetic: bool = True) -> Column:
    """One key array per keyed token."""
    return F.filter(F.transform(tokens, lambda t: token_keys(t, phonetic)), lambda g: F.size(g) > 0)


def name_keys(c: Column, phonetic: bool = True) -> Column:
    """Union of the keys of a name's tokens."""
    return F.array_distinct(F.flatten(key_groups(name_tokens(c), phonetic)))


def keyed_tokens(tokens: Column, phonetic: bool = True) -> Column:
    """Tokens with their keys: ``array<struct<t, k>>``."""
    return F.transform(tokens, lambda t: F.struct(t.alias("t"), token_keys(t, phonetic).alias("k")))


def name_forms(names: Column, phonetic: bool = True, keyed: bool = True) -> Column:
    """``array<string>`` of names -> ``array<struct<name, key, tokens>>`` for pair scoring; tokens have no keys unless ``keyed``."""
    def tokens(ts: Column) -> Column:
        bare = F.transform(ts, lambda t: F.struct(t.alias("t"), F.array().cast("array<string>").alias("k")))
        return (keyed_tokens(ts, phonetic) if keyed else bare).alias("tokens")

    return F.transform(names, lambda n: let(name_tokens(n), lambda ts: F.struct(
        n.alias("name"), F.array_join(ts, " ").alias("key"), tokens(ts))))
