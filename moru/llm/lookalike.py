"""One form for texts that look the same (problem 8).

A text is folded sign by sign (full-width forms, compatibility ideographs, ligatures, special spaces, signs without
width, canonical composition). Look-alike letters are then repaired token by token: a token that mixes scripts is spelled
in its dominant script, or else in another of its scripts, when that spelling is a word of the corpus vocabulary. Tokens of one
script are never changed, so genuine Russian or Greek stays what it is. For comparisons the canonical text has a ``form``
in which the letters that can't be told apart at all are one: texts that read the same sign for sign have one form, and
visibly different ones have different forms.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moru.session import broadcast_if_small, checkpoint

# Letters of other scripts and the Latin letters they can't be told from.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсхуһԁԛԝ", "ABESIJKMHOPCTXYaesijopcxyhdqw", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳ", "ABEZHIKMNOPTYXoj", strict=True))
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
SPACES = "               　"
NO_WIDTH = "­͏؜ᅟᅠ᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
HYPHENS = "‐‑"

TO_LATIN = str.maketrans(CYRILLIC | GREEK)
# Letters that are only nearly the same, taken for each other within a token of mixed scripts alone.
NEAR = {
    "Cyrillic": dict(zip("ӏӀѵүҮԍԌԜԚѴԼ", "lIvyYGGWQVL", strict=True)),
    "Greek": dict(zip("αγικνρυχωϲϹ", "ayiknpuxwcC", strict=True)),
    "Armenian": dict(zip("օսհոցաՕՍՏԼՀ", "ouhngwOUSLZ", strict=True)),
    "Cherokee": dict(zip("ᎪᎢᏚᏟᎡᎻᎷᎬᎫᎳᏙᏴᏀᏞᏢᏃᎠᏆᏦ", "ATSCRHMEJWVBGLPZDIK", strict=True)),
}
#: The Latin letter of each letter of another script, and of each script the letter for a Latin one.
LATIN_OF = CYRILLIC | GREEK | {k: v for t in NEAR.values() for k, v in t.items()}
SAME = {"Cyrillic": CYRILLIC, "Greek": GREEK}
LETTER_OF = {script: {v: k for k, v in [*near.items(), *SAME.get(script, {}).items()]} for script, near in NEAR.items()}


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for c in [*range(0xFF01, 0xFF5F), *range(0xFF61, 0xFFDD), *range(0xFFE0, 0xFFE7)]:  # full- and half-width forms
        table[c] = unicodedata.normalize("NFKC", chr(c))
    table.update({ord(c): " " for c in SPACES} | {ord(c): None for c in NO_WIDTH} | {ord(c): "-" for c in HYPHENS})
    table.update({c: None for c in [*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]})  # variation selectors
    table.update({ord(k): v for k, v in LIGATURES.items()} | {0x2028: "\n", 0x2029: "\n"})
    return table


FOLD = _fold_table()
#: A lone leading, vowel or trailing jamo reads as the letter of the compatibility block with the same name.
JAMO = {}
for _c in [*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]:
    _name = unicodedata.name(chr(_c)).split()[-1]
    try:
        JAMO[_c] = unicodedata.lookup(f"HANGUL LETTER {_name}")
    except KeyError:
        pass
#: Texts of these signs alone are in their one form already; the class is read by Python and by the JVM.
PLAIN_SIGNS = r"\x00-\x0c\x0e-\x7f가-힣一-鿿ぁ-ゖァ-ヺー、。「」『』《》①-⑳㉠-㉭·“”‘’…"
PLAIN = regex.compile(f"[{PLAIN_SIGNS}]*")
ODD = regex.compile(r"[\p{Greek}\p{Cyrillic}]")
SCRIPTS = {x: regex.compile(rf"\p{{{x}}}") for x in ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee")}
TOKEN = regex.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}\p{M}]+")
OTHER = regex.compile(r"[\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}]")
#: What stands between the same tokens, for the JVM.
BETWEEN_JVM = r"[^\p{IsLatin}\p{IsGreek}\p{IsCyrillic}\p{IsArmenian}\p{IsCherokee}\p{M}]+"
VISIBLE = regex.compile(r"[^\p{Z}\p{C}\p{M}\s]")


def fold(text: str) -> str:
    """``text`` sign by sign in its ordinary form; look-alike letters stay."""
    if PLAIN.fullmatch(text):
        return text
    text = unicodedata.normalize("NFC", text.replace("\r\n", "\n").translate(FOLD))
    return text.translate(JAMO) if regex.search("[ᄀ-ᇿ]", text) else text


def skeleton(text: str) -> str:
    """The class of a text or token: equal for those that can't be told apart."""
    if not ODD.search(text):
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(TO_LATIN))


def spellings(token: str) -> list[str]:
    """The spellings of ``token`` in one of its scripts, the dominant one first; none for a token of one script.

    The script of most letters is dominant, of letters without a look-alike in case of a tie.
    """
    letters = unicodedata.normalize("NFD", token)
    found = {s: p.findall(letters) for s, p in SCRIPTS.items()}
    found = {s: x for s, x in found.items() if x}
    if len(found) < 2:
        return []
    alone = {s: sum((c not in LATIN_OF) if s != "Latin" else all(c not in t for t in LETTER_OF.values()) for c in x) for s, x in found.items()}
    out = []
    for script in sorted(found, key=lambda s: (-len(found[s]), -alone[s], s)):
        own = LETTER_OF.get(script, {})
        new = [c if SCRIPTS[script].match(c) or not regex.match(r"\p{L}", c) else own.get(LATIN_OF.get(c, c)) if script != "Latin" else LATIN_OF.get(c) for c in letters]
        if None not in new:
            out.append(unicodedata.normalize("NFC", "".join(new)))
    return out


def mixed_tokens(folded: str) -> list[str]:
    return sorted({t for t in TOKEN.findall(folded) if OTHER.search(t) and spellings(t)}) if OTHER.search(folded) else []


def rewrite(folded: str, spelling: dict[str, str]) -> str:
    return TOKEN.sub(lambda m: spelling.get(m.group(), m.group()), folded) if spelling else folded


def _options(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, token, rank, option, word`` for each mixed token of each text: its spellings and the words they would be."""
    for batch in batches:
        out: list[tuple[str, str, int, str, str]] = []
        for key, t in zip(*(c.to_pylist() for c in batch.columns)):
            if OTHER.search(t):
                out += [(key, x, i, o, o.lower()) for x in mixed_tokens(fold(t)) for i, o in enumerate(spellings(x))]
        cols = [*zip(*out)] if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()))], ["key", "token", "rank", "option", "word"])


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        new, forms, seen = [], [], []
        for t, pairs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            c = rewrite(fold(t), dict(pairs or []))
            new.append(c)
            forms.append(skeleton(c))
            seen.append(bool(VISIBLE.search(c)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(new, pa.string()), pa.array(forms, pa.string()), pa.array(seen, pa.bool_())], ["doc_id", "text", "canonical", "form", "visible"])


def is_special(text: Column) -> Column:
    """``text`` has a sign that isn't plain. Most texts pass by the first test, whose two ranges cost little a sign."""
    return F.coalesce(~text.rlike(r"\A[\x00-\x0c\x0e-\x7f가-힣]*+\z") & text.rlike(f"[^{PLAIN_SIGNS}]"), F.lit(False))


def _split(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The plain texts, which never leave the JVM, and the special ones in their canonical form."""
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    special = is_special(F.col("text"))
    visible = F.coalesce(F.col("text").rlike(r"[^\p{Z}\p{C}\p{M}\s]"), F.lit(False))
    plain = src.where(~special).select("doc_id", "text", F.col("text").alias("canonical"), F.col("text").alias("form"), visible.alias("visible"))
    other = src.where(special).withColumn("key", F.md5("text"))

    options = checkpoint(other.select("key", "text").mapInArrow(_options, "key string, token string, rank int, option string, word string").distinct())
    wanted = checkpoint(options.select("word").distinct())
    n = wanted.count()
    if n == 0:
        mended = other.select("doc_id", "text", F.lit(None).cast("map<string,string>").alias("pairs"))
    else:
        latin = src.where(~special & F.col("text").rlike("[A-Za-z]")).select(F.split("text", "[^A-Za-z]+").alias("ws"))
        rest = src.where(special).select(F.split("text", BETWEEN_JVM).alias("ws"))
        words = latin.unionByName(rest).select(F.explode(F.array_distinct(F.transform("ws", F.lower))).alias("word"))
        vocabulary = words.join(broadcast_if_small(wanted, n), "word", "left_semi").distinct()
        best = options.select("token", "rank", "option", "word").distinct().join(vocabulary, "word", "left_semi").groupBy("token").agg(F.min_by("option", "rank").alias("best"))
        by_text = options.select("key", "token").distinct().join(best, "token").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("token", "best"))).alias("pairs"))  # the tokens of one text
        by_text = checkpoint(by_text)
        mended = other.join(broadcast_if_small(by_text, by_text.count(), 20_000), "key", "left").select("doc_id", "text", "pairs")
    return plain, mended.mapInArrow(_rewritten, f"doc_id {kind}, text string, canonical string, form string, visible boolean")


def canonical_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, canonical, form, visible`` of every row.

    ``canonical`` is the folded and repaired text, ``form`` the one form of all texts that look like it. Only the spellings that mixed
    tokens could have are looked up in the vocabulary of all texts. Null texts stay null, empty and blank ones are not
    ``visible``, repeated rows come out repeated, an empty table gives an empty one, other columns are ignored.
    """
    plain, special = _split(df, id_col, text_col)
    return plain.unionByName(special)


def lookalike_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_a, doc_b``: two rows with a visible sign whose texts are different strings of one canonical form.

    Only forms with more than one spelling are joined. Null and blank texts and null ids are in no pair.
    """
    plain, special = (
        t.where("visible and doc_id is not null").select("doc_id", F.unhex(F.md5("form")).alias("form"), F.unhex(F.md5("text")).alias("spelling"))
        for t in _split(df, id_col, text_col)
    )
    special = checkpoint(special.distinct())
    forms = checkpoint(special.select("form").distinct())  # a plain text is its own form, so two spellings need a special one
    keyed = special.unionByName(plain.join(broadcast_if_small(forms, forms.count()), "form", "left_semi").distinct())
    several = keyed.groupBy("form").agg(F.min("spelling").alias("a"), F.max("spelling").alias("b")).where("a <> b").select("form")
    rows = checkpoint(keyed.join(several, "form", "left_semi"))
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col("a.form") == F.col("b.form")) & (F.col("a.spelling") != F.col("b.spelling")) & (F.col("a.doc_id") < F.col("b.doc_id"))
    return a.join(b, same).select(F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"))
