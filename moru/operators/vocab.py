"""Vocabulary: pieces, counts, training, lookup, decoding and audits.

Pieces come from a segmenter, a column function from a word to an array of pieces; the default takes whole words. A
morphological segmenter is given as an Arrow UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moru.functions import text as T
from moru.operators.order import dense_index
from moru.operators.quality import band

# The special tokens in order of their ids, and the mark of a word's first piece.
SPECIALS = ["<pad>", "<unk>", "<bos>", "<eos>"]
PAD, UNK, BOS, EOS = range(4)
WORD_START = "▁"
CHARS = 4000


def words(c: Column | str) -> Column:
    """The words of a text between white space."""
    return F.filter(F.split(c, f"{T.SPACE}+"), lambda w: w != "")


def pieces(c: Column | str, segment: Callable[[Column], Column] | None = None) -> Column:
    """All pieces of a text; the first of each word has the word mark."""
    if segment is None:
        return F.transform(words(c), lambda w: F.concat(F.lit(WORD_START), w))
    return F.flatten(F.transform(words(c), lambda w: F.transform(segment(w), lambda p, i: F.concat(F.when(i == 0, WORD_START).otherwise(""), p))))


def piece_counts(df: DataFrame, text: str = "text", segment: Callable[[Column], Column] | None = None) -> DataFrame:
    """``piece, n``: counted with partial sums before the shuffle, exactly; nothing is pruned."""
    return df.select(F.explode(pieces(text, segment)).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def char_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``ch, n`` of the signs that are neither white space nor Hangul syllables."""
    kept = F.regexp_replace(text, rf"[{T.SPACE_IN}{T.HANGUL}]", "")
    return df.select(F.explode(F.split(kept, "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))


def approx_heavy_hitters(df: DataFrame, k: int, text: str = "text") -> DataFrame:
    """``piece, n`` of about the ``k`` most frequent pieces from a bounded sketch, for a first look."""
    top = df.select(F.explode(pieces(text)).alias("piece")).agg(F.expr(f"approx_top_k(piece, {k})").alias("t"))
    return top.select(F.explode("t").alias("t")).select(F.col("t.item").alias("piece"), F.col("t.count").alias("n"))


def train(df: DataFrame, size: int, text: str = "text", segment: Callable[[Column], Column] | None = None, chars: int = CHARS) -> DataFrame:
    """``id, token``: the specials, all syllables and printable ASCII signs and the ``chars`` most frequent other ones (each with and
    without the word mark), then the most frequent pieces up to ``size``. Ties go by code point, so ids are the same in every run."""
    spark = df.sparkSession
    fixed = spark.createDataFrame([(0, i, t) for i, t in enumerate(SPECIALS)], "section int, rank long, token string")
    base = spark.range(0xAC00, 0xD7A4).select(F.col("id").alias("c")).unionByName(spark.range(0x21, 0x7F).select(F.col("id").alias("c")))
    base = base.select(F.lit(1).alias("section"), F.when(F.col("c") >= 0xAC00, F.col("c") - 0xAC00).otherwise(F.col("c") + 20000).alias("rank"), "c")
    base = base.select("section", "rank", F.when(F.col("c") < 128, F.char("c")).otherwise(F.decode(F.unhex(_utf8_hex(F.col("c"))), "UTF-8")).alias("token"))
    other = char_counts(df, text).where(~F.col("ch").rlike(r"[\x21-\x7e]")).orderBy(F.desc("n"), "ch").limit(chars)
    other = other.select(F.lit(2).alias("section"), F.row_number().over(Window.orderBy(F.desc("n"), "ch")).cast("long").alias("rank"), F.col("ch").alias("token"))  # at most `chars` rows
    single = base.unionByName(other)
    both = single.select("section", (F.col("rank") * 2).alias("rank"), F.concat(F.lit("<c:"), "token", F.lit(">")).alias("token")).unionByName(
        single.select("section", (F.col("rank") * 2 + 1).alias("rank"), F.concat(F.lit(f"<c:{WORD_START}"), "token", F.lit(">")).alias("token"))
    )
    room = max(0, size - len(SPECIALS) - 2 * (11172 + 94))
    common = piece_counts(df, text, segment).orderBy(F.desc("n"), "piece").limit(room)
    common = common.select(F.lit(3).alias("section"), F.row_number().over(Window.orderBy(F.desc("n"), "piece")).cast("long").alias("rank"), F.col("piece").alias("token"))  # at most `size` rows
    out = dense_index(fixed.unionByName(both).unionByName(common), "section", "rank", name="id", parts=4)
    return out.where(F.col("id") < max(size, len(SPECIALS) + 2 * (11172 + 94 + chars))).select(F.col("id").cast("int").alias("id"), "token")


def _utf8_hex(c: Column) -> Column:
    """The UTF-8 bytes of code points from U+0800 to U+FFFF in hexadecimal."""
    b = (F.lit(0xE0) + F.shiftright(c, 12), F.lit(0x80) + F.shiftright(c, 6).bitwiseAND(63), F.lit(0x80) + c.bitwiseAND(63))
    return F.concat(*[F.lpad(F.hex(x.cast("long")), 2, "0") for x in b])


def top_pieces(df: DataFrame, n: int, text: str = "text", segment: Callable[[Column], Column] | None = None) -> DataFrame:
    """``rank, piece, n``: the ``n`` most frequent pieces, ties by code point."""
    top = piece_counts(df, text, segment).orderBy(F.desc("n"), "piece").limit(n)
    return top.select(F.row_number().over(Window.orderBy(F.desc("n"), "piece")).alias("rank"), "piece", "n")  # at most n rows


def encode(df: DataFrame, vocab: DataFrame, id_col: str, text: str = "text", segment: Callable[[Column], Column] | None = None, bos: bool = False, eos: bool = False, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``id_col, ids``: each piece's id, or the ids of its signs where the vocabulary lacks it, or the unknown id for signs it lacks too.

    A vocabulary of at most ``broadcast_rows`` tokens is broadcast and every text encoded where it is, without a shuffle. A
    larger one is joined to the distinct pieces and their signs. Null and empty texts have no ids but the ends asked for.
    """
    rows = df.select(F.col(id_col), pieces(text, segment).alias("_ps"))
    ends = [F.array(F.lit(BOS))] if bos else []
    tails = [F.array(F.lit(EOS))] if eos else []
    known = vocab.select("token", "id").limit(broadcast_rows + 1).collect()
    got = _encode_here(rows, id_col, {r.token: r.id for r in known}) if len(known) <= broadcast_rows else _encode_joined(rows, id_col, vocab.select("token", "id"))
    return got.select(id_col, F.concat(*ends, "ids", *tails).alias("ids"))


def _encode_here(rows: DataFrame, id_col: str, ids: dict[str, int]) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, list[int]] = {}
        get = held.value.get

        def code(p: str) -> list[int]:
            whole = get(p)
            if whole is not None:
                return [whole]
            marked, signs = p.startswith(WORD_START), p.removeprefix(WORD_START)
            return [get(f"<c:{WORD_START if marked and i == 0 else ''}{c}>", UNK) for i, c in enumerate(signs)] or [UNK]

        for batch in batches:
            out = []
            for ps in batch.column(1).to_pylist():
                row: list[int] = []
                for p in ps or ():
                    c = memory.get(p)
                    if c is None:
                        if len(memory) > 500_000:
                            memory.clear()
                        c = memory[p] = code(p)
                    row += c
                out.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], [batch.schema.names[0], "ids"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, ids array<int>")


def _encode_joined(rows: DataFrame, id_col: str, v: DataFrame) -> DataFrame:
    distinct = rows.select(F.explode("_ps").alias("piece")).distinct()
    v = v.select("token", F.col("id").alias("_tid"))
    whole = distinct.join(v, distinct.piece == v.token, "left").select("piece", "_tid")
    rest = whole.where("_tid is null").select("piece", F.posexplode(F.split(F.regexp_replace("piece", f"^{WORD_START}", ""), "")).alias("at", "c")).where("c <> ''")
    token = F.concat(F.lit("<c:"), F.when((F.col("at") == 0) & F.col("piece").startswith(WORD_START), WORD_START).otherwise(""), "c", F.lit(">"))
    signs = rest.withColumn("token", token).join(v.withColumnRenamed("_tid", "_cid"), "token", "left").groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("_cid", F.lit(UNK)).alias("i")))).alias("s"))
    coded = whole.join(signs, "piece", "left").select("piece", F.when(F.col("_tid").isNotNull(), F.array("_tid")).when(F.col("s").isNotNull(), F.transform("s", lambda x: x["i"])).otherwise(F.array(F.lit(UNK))).alias("_ids"))
    keyed = rows.withColumn("_row", F.md5(F.array_join("_ps", "\u0001")))  # equal texts have equal ids
    at = keyed.select("_row", "_ps").distinct().select("_row", F.posexplode("_ps").alias("_at", "piece")).join(coded, "piece").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "_ids"))).alias("_l"))  # one text
    ids = F.coalesce(F.flatten(F.transform("_l", lambda x: x["_ids"])), F.array().cast("array<int>"))
    return keyed.join(at, "_row", "left").select(id_col, ids.alias("ids"))


def decode(df: DataFrame, vocab: DataFrame, id_col: str, ids: str = "ids") -> DataFrame:
    """``id_col, text``: specials skipped, unknown ids as ``<unk>``, signs joined to words, words with a space between."""
    v = vocab.select(F.col("id").alias("_tid"), F.col("token").alias("_token"))
    e = df.select(id_col, F.posexplode(ids).alias("_at", "_tid")).where(~F.col("_tid").isin(PAD, BOS, EOS)).join(v, "_tid", "left")
    form = F.when(F.col("_token").isNull() | (F.col("_tid") == UNK), f"{WORD_START}<unk>").otherwise(F.regexp_replace("_token", r"^<c:(.*)>$", "$1"))
    got = e.select(id_col, "_at", form.alias("p")).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_at", "p"))).alias("_l"))  # one text
    text = F.regexp_replace(F.array_join(F.transform("_l", lambda x: x["p"]), ""), WORD_START, " ")
    return df.select(id_col).join(got, id_col, "left").select(id_col, F.coalesce(F.ltrim(text), F.lit("")).alias("text"))


def _ranges(codes: set[int]) -> str:
    """The inside of a regular expression class of ``codes``."""
    starts, ends = sorted(c for c in codes if c - 1 not in codes), sorted(c for c in codes if c + 1 not in codes)
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends))


def decoded_form(c: Column | str, vocab: DataFrame) -> Column:
    """What decoding an encoded text gives, said without ids: its words with a space between, and ``<unk>`` with a space before it for each sign
    that ``vocab`` lacks in a word that it lacks. The signs besides syllables and ASCII and the words with a sign that is none come to the driver."""
    tokens = vocab.select("token").where(F.col("id") > EOS)
    sign = rf"^<c:{WORD_START}?.>$"
    known = [F.regexp_extract("token", rf"^<c:({WORD_START}?.)>$", 1).alias("s")]
    found = {r.s for r in tokens.where(F.col("token").rlike(sign)).select(*known).collect()}
    inner, first = (_ranges({ord(s[-1]) for s in found if (len(s) == 2) == at}) for at in (False, True))
    odd = rf"^[^{first}]|(?<=.)[^{inner}]"
    whole = [r.w for r in tokens.select(F.substring("token", 2, 1 << 20).alias("w")).where(F.col("token").startswith(WORD_START) & F.col("w").rlike(f"(?s){odd}")).collect()]
    form = lambda w: F.when(w.isin(whole), F.concat(F.lit(" "), w)).otherwise(F.regexp_replace(F.concat(F.when(w.rlike(rf"^[^{first}]"), "").otherwise(" "), F.regexp_replace(w, f"(?s){odd}", " <unk>")), r"\A +", " "))
    return F.ltrim(F.array_join(F.transform(words(c), form), ""))


def unknown_audit(encoded: DataFrame, ids: str = "ids") -> DataFrame:
    """One row ``tokens, unknown, ratio, band``; zeros for an empty table."""
    n = encoded.agg(F.coalesce(F.sum(F.size(ids)), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.size(F.filter(ids, lambda i: i == UNK))), F.lit(0)).alias("unknown"))
    ratio = F.coalesce(F.try_divide("unknown", "tokens"), F.lit(0.0))
    return n.select("tokens", "unknown", ratio.alias("ratio"), band(ratio).alias("band"))


def missing_pieces(df: DataFrame, vocab: DataFrame, text: str = "text") -> DataFrame:
    """``piece, n`` of the pieces that the vocabulary lacks."""
    return piece_counts(df, text).join(vocab.select(F.col("token").alias("piece")), "piece", "left_anti")


def batch_encode(encoded: DataFrame, id_col: str, most: int, ids: str = "ids", batch: Column | None = None) -> DataFrame:
    """``id_col, input_ids, attention_mask``: cut at ``most`` and padded to the longest of the batch."""
    b = batch if batch is not None else F.lit(0)
    rows = encoded.select(id_col, F.slice(ids, 1, most).alias("_x"), b.alias("_b"))
    longest = rows.groupBy("_b").agg(F.max(F.size("_x")).alias("_n"))
    n = F.col("_n") - F.size("_x")
    return rows.join(longest, "_b").select(id_col, F.concat("_x", F.array_repeat(F.lit(PAD), n)).alias("input_ids"), F.concat(F.transform("_x", lambda _: F.lit(1)), F.array_repeat(F.lit(0), n)).alias("attention_mask"))


def health(df: DataFrame, pieces_col: str, least: int = 3, letters: str = T.HANGUL, top: str | None = None, sure: float = 0.02) -> DataFrame:
    """``df`` with ``n_ko``, the number of pieces with a letter of the script, and ``verdict``: coherent from ``least`` on, given also
    that the probability ``top`` of the first piece, where there is one, is above ``sure``."""
    n = F.size(F.filter(pieces_col, lambda p: p.rlike(f"[{letters}]")))
    good = (F.col("n_ko") >= least) & (F.col(top) > sure if top else F.lit(True))
    return df.withColumn("n_ko", n).withColumn("verdict", F.when(good, "coherent").otherwise("broken"))
