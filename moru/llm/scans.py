"""Noise of scanned pages in item texts (problem 1).

Running heads come from the pages themselves: what the first lines of a file's pages have in common. Page numbers are
recognised by their form. What is left of a text is read through a noisy channel: for each word that the corpus doesn't
know, candidates are the corpus words from which it can come by a confusion (similar letters, signs for letters, split
syllables, stray marks). How likely each confusion is gets estimated from the scanned texts themselves by expectation
maximisation, from a prior by kinds; word pairs and words of the corpus that aren't from scans give the n-gram likelihood; and Viterbi decoding over each
paragraph chooses between the candidates and the word as it stands, sound or misread beyond repair.
"""

from __future__ import annotations

import math

from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moru.session import broadcast_if_small, checkpoint

#: Words of the lexicon: all those read at least LEAST times and in SHARE of all words, so 1 / SHARE of them at the very most.
#: It is broadcast; all other words are judged by their letters.
LEAST, SHARE = 5, 2e-7
#: The likelihood that a sound word has a letter, pair of letters or sign that the corpus doesn't have; and the count of one never seen.
FOREIGN, UNSEEN = math.log(3e-7), 0.006
#: Weight of a word's own share of the corpus beside its share after the word before it; of the latter each pair counts one
#: less than it is seen, over the count of the word before and a few more, so that pairs seen once say nothing.
ALONE, MORE = 0.5, 50

# The prior of the channel, as logarithms of the probability of an error in a word and of its kinds, and
# the occurrences of a letter that it weighs as much as. Rounds of estimation.
ERROR = math.log(0.004)
KINDS = {"sign": -1.0, "split": -1.0, "similar": math.log(1 / 4), "vowel": math.log(1 / 40), "jamo": math.log(1 / 400), "letter": math.log(1 / 3000)}
PSEUDO, ROUNDS = 2000, 3
#: Of the classes of neighbours: known word (0) or unknown word (1), the earlier one first.
AFTER = {(0, 0): math.log(0.95), (0, 1): math.log(0.05), (1, 0): math.log(0.97), (1, 1): math.log(0.03)}
LATIN_PAIRS = [("c", "e"), ("b", "h"), ("1", "l"), ("I", "l"), ("0", "o"), ("!", "i"), ("h", "b"), ("l", "i"), ("5", "s"), ("6", "b"), ("9", "g"), ("q", "g"), ("u", "v"), ("f", "t"), ("8", "B")]
LATIN_GROUPS = [("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("h", "li"), ("nn", "m")]
SIGNS = "�|※■□¦▯▮◆●"
HYPHENS = "-‐‑¬­–⁃﹣－"
EDGE = " \t.,?!\"'()[]{}<>〈〉《》“”‘’「」『』:;…·*①②③④⑤⑥⑦⑧⑨⑩"
EDGE_LEFT = EDGE.replace("!", "")  # at the start of a word it stands for a letter
QUOTES = "'‘’"
STRAY = regex.compile(r"(?<=[가-힣])['‘’](?=[가-힣]|[.,]?$)")
SPLIT = regex.compile(r"([ㄱ-ㅎ])([ㅏ-ㅣ])([ㄱ-ㅎ](?![ㅏ-ㅣ]))?")
OI = regex.compile(r"(?<=[가-힣])[oO0ㅇ][|lI1!]|[oO0ㅇ][|lI1!](?=[가-힣])")
LEAD = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
TAIL = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"

NUM = r"[0-9lIOoｌ|]{1,4}"
PAGE_NO = regex.compile(
    rf"^[\s\p{{P}}|]*(?:(?:p|pp|page|쪽|면)\s*\.?\s*)?(?:제\s*)?{NUM}(?:\s*(?:/|of|-|／)\s*{NUM})?\s*(?:쪽|면|페이지|page)?[\s\p{{P}}|]*$|^[\s\p{{P}}]*[ivx]{{1,5}}[\s\p{{P}}]*$", regex.I
)
EDGE_NO = regex.compile(rf"^\s*[\p{{P}}]*\s*(?:p\.\s*)?{NUM}\s*(?:쪽|면)?\s*[\p{{P}}]*\s{{2,}}(?=\S)|(?<=\S)\s{{2,}}[\p{{P}}]*\s*(?:p\.\s*)?{NUM}(?:\s*/\s*{NUM})?\s*(?:쪽|면)?\s*[\p{{P}}]*\s*$")
BARE_NO, ROW_OF_VALUES = regex.compile(r"\s*\d+\s*"), regex.compile(r"\s*[\d.,%+−±|/\s-]*\d[\d.,%+−±|/\s-]*")
NOT_LETTERS = regex.compile(r"[^\p{L}\p{N}]+")
COUNTS = regex.compile(r"[0-9lIO]|[ivx]")
READABLE = regex.compile(r"\p{L}|[" + SIGNS + "]")
HAS_LATIN = regex.compile(r"[A-Za-z]")
BROKEN = regex.compile(r"[ㄱ-ㅎ][ㅏ-ㅣ]|�|(?<=\p{L})[|※■□¦▯▮◆●]|[|■□¦▯](?=\p{L})|[A-Za-z][0-9!](?=[A-Za-z])")
WORD_LIKE = regex.compile(r"[가-힣\p{Latin}'-]+")
SENTENCE_END = regex.compile(r"(?:[가-힣]다|시오|세요|[.?!])[\s\p{P}]*$")


def squeeze(line: str) -> str:
    return NOT_LETTERS.sub("", line).casefold()


def bare_head(line: str) -> str:
    """A running head without a page number beside it, its letters and digits only."""
    return squeeze(EDGE_NO.sub("", line))


def grams(s: str) -> set[str]:
    return {s[i : i + 2] for i in range(len(s) - 1)}


def is_head(line: str, heads: list[set[str]]) -> bool:
    """``line`` repeats one of the file's heads, perhaps longer, shorter or misread."""
    if not heads or SENTENCE_END.search(line.rstrip(" )）]")):
        return False
    g = grams(bare_head(line))
    return len(g) >= 4 and any(len(g & h) >= 0.6 * min(len(g), len(h)) and len(g & h) >= 0.45 * max(len(g), len(h)) for h in heads)


def furniture(lines: list[str], heads: list[set[str]]) -> list[set[str]]:
    """For each line, whether it is a ``header`` or ``pageno``. Numbers that count 1, 2, 3 ... before lines of a list are none,
    nor are bare numbers beside a row of values."""
    out = []
    for x in lines:
        k: set[str] = set()
        if is_head(x, heads):
            k.add("header")
            if EDGE_NO.search(x):
                k.add("pageno")
        elif len(x) < 24 and PAGE_NO.match(x) and COUNTS.search(x):
            k.add("pageno")
        out.append(k)
    counted = [(i, int(x.strip())) for i, (x, k) in enumerate(zip(lines, out)) if k == {"pageno"} and x.strip().isdecimal()]
    if len(counted) >= 3 and [n for _, n in counted] == list(range(counted[0][1], counted[0][1] + len(counted))):
        for i, _ in counted:
            out[i] = set()
    rows = [bool(ROW_OF_VALUES.fullmatch(x)) for x in lines]
    for i, (x, k) in enumerate(zip(lines, out)):
        if k == {"pageno"} and BARE_NO.fullmatch(x) and (i and rows[i - 1] or i + 1 < len(lines) and rows[i + 1]):
            out[i] = set()
    return out


class State(NamedTuple):
    """What a word can be: its spelling, likelihood, class (0 known, 1 unknown), and whether that makes it misread."""

    word: str
    score: float
    kind: int
    misread: bool


class Model:
    """The lexicon, the letters of unknown words, and the channel.

    ``edits`` are the expected numbers of confusions ``(read, meant)`` in ``scanned`` words of scanned texts.
    """

    def __init__(self, words: dict[str, int], total: int, letters: dict[str, int], edits: dict[tuple[str, str], float] | None = None, scanned: int = 0) -> None:
        self.total = max(total, 1)
        self.words = words
        self.letters = Counter(letters)
        self.n_one = max(1, sum(n for g, n in letters.items() if len(g) == 1))
        known = Counter()
        for w, n in words.items():
            for g in pieces(w):
                known[g] += n
        self.seen = known + self.letters
        self.n_seen = max(1, sum(n for g, n in self.seen.items() if len(g) == 1))
        self.unknown = math.log(max(1, self.total - sum(words.values())) / self.total)
        self.edits, self.scanned = edits or {}, scanned
        self.patterns: dict[str, list[str]] = defaultdict(list)
        for w in words:
            for i in range(len(w)):
                self.patterns[w[:i] + "\0" + w[i + 1 :]].append(w)
        self.memory: dict[tuple[str, bool], list[State]] = {}

    def parts(self) -> tuple:
        """What a worker makes the model of."""
        return self.words, self.total, dict(self.letters), self.edits, self.scanned

    def known(self, w: str) -> float | None:
        n = self.count(w)
        return math.log(n / self.total) if n else None

    def count(self, w: str) -> int:
        return self.words.get(w) or self.words.get(w.lower()) or self.words.get(w.capitalize()) or 0

    def as_unknown(self, w: str) -> float:
        """The likelihood of an unknown word by its letters; of a Latin letter after another by the two."""
        out, last = self.unknown, ""
        for c in w.lower():
            latin = c.isascii() and c.isalpha()
            if latin and last:
                out += math.log((self.letters[last + c] + 0.01) / (self.letters[last] + 1))
            else:
                n = self.letters[c]
                out += math.log(n / self.n_one if n else 0.05 / self.n_one)
            last = c if latin else ""
        return out

    def strange(self, w: str) -> float:
        """By how much less likely a sound word has the signs and letters of ``w`` than a misread one."""
        out = FOREIGN * (len(BROKEN.findall(w)) + len(OI.findall(w)))
        if WORD_LIKE.fullmatch(w):
            out += sum(min(0.0, math.log((self.seen[g] or UNSEEN) / self.n_seen) - FOREIGN) for g in pieces(w) if len(g) == 2 or "가" <= g <= "힣")
        return out

    def cost(self, kind: str, read: str = "", meant: str = "") -> float:
        """The likelihood of the confusion: expected from the scanned texts, by its kind's prior where they say little."""
        of = self.seen[meant.lower()] * self.scanned / self.total if len(meant) == 1 else self.scanned
        return math.log((PSEUDO * math.exp(ERROR + KINDS[kind]) + self.edits.get((read, meant), 0.0)) / (PSEUDO + of))

    def channel(self, read: str, meant: str) -> tuple[str, str, str] | None:
        """The confusion ``(kind, read, meant)`` by which one letter is read as another, if there is one."""
        if read in SIGNS:
            return "sign", "", ""
        if "가" <= read <= "힣" and "가" <= meant <= "힣":
            a, b = ord(read) - 0xAC00, ord(meant) - 0xAC00
            differ = (a // 588 != b // 588, a // 28 % 21 != b // 28 % 21, a % 28 != b % 28)
            return "letter" if sum(differ) > 1 else "vowel" if differ[1] else "jamo", read, meant
        if meant.isascii() and meant.isalpha():
            if (read.lower(), meant.lower()) in LATIN_SET or (read, meant) in LATIN_SET:
                return "similar", read, meant
            return ("letter", read, meant) if read.isascii() and read.isalpha() and read.lower() != meant.lower() else None
        return None

    def options(self, w: str) -> Iterator[tuple[str, tuple[str, str, str]]]:
        """The corpus words that ``w`` can be misread for, each with its confusion."""
        joined = SPLIT.sub(compose, w)
        if joined != w:
            yield joined, ("split", "", "")
        if OI.search(w):
            yield OI.sub("이", w), ("split", "", "")
        for i in range(len(w)):
            for c in self.patterns.get(w[:i] + "\0" + w[i + 1 :], ()):
                if edit := self.channel(w[i], c[i]):
                    yield c, edit
        if HAS_LATIN.search(w):
            for read, meant in LATIN_GROUPS:
                at = w.find(read)
                while at >= 0:
                    yield w[:at] + meant + w[at + len(read) :], ("similar", read, meant)
                    at = w.find(read, at + 1)

    def states(self, w: str, stray: bool = False) -> list[State]:
        """What ``w`` can be, first the word as it stands; ``stray``: with a quotation mark that closes nothing."""
        got = self.memory.get((w, stray))
        if got is not None:
            return got
        p = self.known(w)
        if stray:
            out = [State(w, self.as_unknown(w) + FOREIGN, 1, False)]
            out += [State(x.word, x.score + self.cost("sign"), x.kind, True) for x in self.states(STRAY.sub("", w))]
        elif p is not None:
            out = [State(w, p, 0, False)]
        else:
            by_letters, strange = self.as_unknown(w), self.strange(w)
            out = [State(w, by_letters + strange, 1, False)]
            if strange < 0:
                out.append(State(OI.sub("이", SPLIT.sub(compose, w)), by_letters, 1, True))
            best: dict[str, float] = {}
            for c, edit in self.options(w):
                if edit[0] == "letter" and "가" <= edit[1] <= "힣" and edit[1:] not in self.edits:
                    continue  # syllables of several other jamo are taken for each other only where the scanned texts show it
                if (q := self.known(c)) is not None:
                    best[c] = max(best.get(c, -math.inf), q + self.cost(*edit))
            out += [State(c, x, 0, True) for c, x in best.items()]
        if len(self.memory) > 300_000:
            self.memory.clear()
        self.memory[w, stray] = out
        return out

    def step(self, a: State, b: State, pairs: dict[tuple[str, str], int]) -> float:
        """The likelihood of ``b`` after ``a``: of known words by their pair, backed off to the word alone."""
        if a.kind or b.kind:
            return AFTER[a.kind, b.kind] + b.score
        seen = max(0, pairs.get((a.word, b.word), 0) - 1)
        own = self.count(b.word) / self.total
        return AFTER[0, 0] + b.score + math.log((1 - ALONE) * seen / (max(seen, self.count(a.word)) + MORE) / own + ALONE)

    def decode(self, words: list[tuple[str, bool]], pairs: dict[tuple[str, str], int]) -> list[State]:
        """The most likely states behind ``words``, by Viterbi."""
        out: list[State] = []
        score, before, back = [0.0], [State("", 0.0, 1, False)], []
        for w, stray in words:
            now = self.states(w, stray)
            if len(now) == 1 and len(before) == 1:  # nothing to choose
                if back:
                    out += self._best(score, back)
                    back = []
                out.append(now[0])
                score, before = [0.0], now
                continue
            new, link = [], []
            for b in now:
                steps = [x + self.step(a, b, pairs) for x, a in zip(score, before)]
                link.append(max(range(len(steps)), key=steps.__getitem__))
                new.append(steps[link[-1]])
            back.append((now, link))
            before, score = now, new
        return out + self._best(score, back) if back else out

    @staticmethod
    def _best(score: list[float], back: list[tuple[list[State], list[int]]]) -> list[State]:
        out, at = [], max(range(len(score)), key=lambda i: score[i])
        for now, link in reversed(back):
            out.append(now[at])
            at = link[at]
        return out[::-1]


LATIN_SET = {*LATIN_PAIRS}


def pieces(w: str) -> Iterator[str]:
    """The letters of ``w``; of Latin letters also each two in a row."""
    low = w.lower()
    for i, c in enumerate(low):
        yield c
        if c.isascii() and c.isalpha() and i + 1 < len(low) and low[i + 1].isascii() and low[i + 1].isalpha():
            yield low[i : i + 2]


def compose(m: regex.Match) -> str:
    a, v, t = m.group(1), m.group(2), m.group(3)
    if a not in LEAD:
        return m.group()
    return chr(0xAC00 + LEAD.index(a) * 588 + (ord(v) - 0x314F) * 28 + (TAIL.index(t) + 1 if t and t in TAIL else 0))


def divided(left: str, right: str, model: Model) -> str:
    """The word that a line end divides after the hyphen of ``left``: with it where the corpus has the word or both halves so, and not the word without it."""
    a, b = left.split()[-1].lstrip(EDGE), right.split()[0].rstrip(EDGE)
    if model.count(a[:-1] + b) or not a[-2:-1].isascii():
        return left[:-1] + right
    with_it = model.count(a[:-1] + "-" + b) or model.count(a[:-1]) and model.count(b)
    return left[:-1] + "-" + right if with_it else left[:-1] + right


def paragraphs(text: str, heads: list[set[str]], model: Model) -> tuple[set[str], list[str]]:
    """The kinds of noise in the lines of ``text``, and its paragraphs without them."""
    lines = text.split("\n")
    kinds = furniture(lines, heads)
    found: set[str] = set().union(*kinds)
    body = [x for x, k in zip(lines, kinds) if not k]
    width = max([len(x.rstrip()) for x in body], default=0)
    out, current = [], ""
    for x in body:
        x = x.strip(" \t\r")
        if not current:
            current = x
            continue
        tail = current[-1]
        if tail in HYPHENS and len(current) > 1 and current[-2].isalpha() and x[:1].isalpha():
            found.add("hyphen")
            current = divided(current, x, model)
        elif not x or (current[-1] in ".?!" and len(current.rsplit("\1", 1)[-1]) < 0.7 * width):
            out.append(current)
            current = x
        else:
            current += " \1" + x
    out.append(current)
    return found, [p.replace("\1", "") for p in out]


def cores(tokens: list[str]) -> list[tuple[str, bool]]:
    """The words within ``tokens``, without the signs around them; and whether a quotation mark in one closes nothing."""
    whole = "".join(tokens)
    if not any(q in whole for q in QUOTES):
        return [(t.rstrip(EDGE).lstrip(EDGE_LEFT), False) for t in tokens]
    out, quoted = [], False
    for t in tokens:
        stray = False
        if any(q in t for q in QUOTES):
            quoted = quoted or t.lstrip("([{<").startswith(tuple(QUOTES))
            stray = not quoted and bool(STRAY.search(t))
            if not stray and (t.rstrip(".,)]}>").endswith(tuple(QUOTES)) or regex.search(r"['’](?=[가-힣])", t)):
                quoted = False
        out.append((t.rstrip(".,").lstrip(EDGE_LEFT) if stray else t.rstrip(EDGE).lstrip(EDGE_LEFT), stray))
    return out


def stretches(words: list[tuple[str, bool]], model: Model) -> list[list[int]]:
    """The places of ``words`` that the corpus doesn't know as they stand, each stretch of them with the words beside it.

    A known word has one state, so what lies beyond it has no bearing on the decoding.
    """
    known = model.words
    doubtful = [stray or bool(c) and c not in known for c, stray in words]
    if not any(doubtful):
        return []
    read = [i for i, (c, _) in enumerate(words) if c and (not doubtful[i] or READABLE.search(c))]
    out: list[list[int]] = []
    for at, i in enumerate(read):
        if doubtful[i]:
            if out and at == out[-1][1] + 1:
                out[-1][1] = at
            else:
                out.append([at, at])
    return [read[max(0, x - 1) : y + 2] for x, y in out]


def mend(text: str, heads: list[set[str]], model: Model, pairs: dict[tuple[str, str], int]) -> tuple[set[str], str]:
    """The kinds of noise in ``text`` and the text as continuous paragraphs."""
    found, body = paragraphs(text, heads, model)
    out = []
    for p in body:
        tokens = p.split()
        words = cores(tokens)
        for places in stretches(words, model):
            for i, m in zip(places, model.decode([words[i] for i in places], pairs)):
                if m.misread:
                    tokens[i] = tokens[i].replace(words[i][0], m.word, 1)
                    found.add("misread")
        out.append(" ".join(tokens))
    return found, "\n".join(x for x in out if x)


def unsure(text: str, heads: list[set[str]], model: Model) -> set[tuple[str, str]]:
    """The pairs of known words between which the decoding of ``text`` may choose."""
    out = set()
    for p in paragraphs(text, heads, model)[1]:
        words = cores(p.split())
        for places in stretches(words, model):
            states = [model.states(*words[i]) for i in places]
            for a, b in zip(states, states[1:]):
                if len(a) > 1 or len(b) > 1:
                    out |= {(x.word, y.word) for x in a if not x.kind for y in b if not y.kind}
    return out


def is_pdf(source_file: str = "metadata.source_file"):
    return F.lower(F.trim(F.col(source_file))).endswith(".pdf")


def _word_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c: Counter[str] = Counter()
        for w in batch.column(0).to_pylist():
            c.update(pieces(w))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["piece", "n"])


def clean_texts(items: DataFrame) -> DataFrame:
    """The items that aren't from scanned pages, or all where there are none."""
    clean = items.where(~F.coalesce(is_pdf(), F.lit(False)))
    return items if clean.isEmpty() else clean


def model_of(items: DataFrame) -> Model:
    """The model, counted over the texts that aren't from scanned pages (over all where those are too few to be one)."""
    tokens = clean_texts(items).select(F.explode(F.split(F.concat_ws(" ", "passage", "question"), r"\s+")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    words = tokens.select(F.btrim("t", F.lit(EDGE)).alias("w"), "n").where("w <> ''").groupBy("w").agg(F.sum("n").alias("n"))
    words = checkpoint(words)
    total = words.agg(F.sum("n")).head()[0] or 0
    least = max(LEAST, SHARE * total)
    lexicon = sorted(words.where(F.col("n") >= least).collect(), key=lambda r: (-r.n, r.w))
    rare = words.where(F.col("n") < least)
    letters = rare.select("w").mapInArrow(_word_pieces, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    model = Model({r.w: r.n for r in lexicon}, total, {r.piece: r.n for r in letters})
    model.rare = rare
    return model


def heads_of(pages: DataFrame) -> DataFrame:
    """``source_file, heads``: the first lines that recur over a file's pages, without their page numbers."""
    first = F.expr(r"filter(split(text, '\n'), x -> x rlike '\\p{L}|\\p{N}')")
    top = pages.where("text is not null").select("source_file", F.get(first, F.lit(0)).alias("line"))
    strip = F.regexp_replace(F.lower(F.regexp_replace("line", r"^\s*\p{P}*\s*[0-9lIO]{1,4}\s*(?:쪽|면)?\s{2,}|\s{2,}\p{P}*\s*[0-9lIO]{1,4}\s*(?:쪽|면)?\s*$", "")), r"[^\p{L}\p{N}]+", "")
    top = top.where(~F.col("line").rlike(r"(다|시오|세요|[.?!])[\s\p{P}]*$") & ~F.col("line").rlike(r"^\s*([①-⑳]|\d{1,3}\.)")).withColumn("head", strip)
    n = top.groupBy("source_file", "head").agg(F.count("*").alias("n")).where(F.length("head") >= 5)
    of = pages.groupBy("source_file").agg(F.count("*").alias("pages"))
    ranked = n.join(of, "source_file").where((F.col("n") >= 2) & (F.col("n") >= 0.15 * F.col("pages")))
    return ranked.groupBy("source_file").agg(F.array_sort(F.collect_list("head")).alias("heads"))  # at most six of a file


def _grams(heads: list[str] | None) -> list[set[str]]:
    return [grams(x) for x in heads or []]


def _unknown(held):
    """``w, n`` for the words of the texts that the corpus doesn't know; the number of all words under ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(held)
        for batch in batches:
            c: Counter[str] = Counter()
            for p, q, h in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                for x in [x for t in (p, q) if t for x in paragraphs(t, _grams(h), model)[1]]:
                    words = [w for w, stray in cores(x.split()) if w and not stray]
                    c[""] += len(words)
                    c.update(w for w in words if model.known(w) is None and READABLE.search(w))
            yield pa.RecordBatch.from_arrays([pa.array([*c], pa.string()), pa.array([*c.values()], pa.int64())], ["w", "n"])

    return run


_OPTION = "struct<base:double,kind:string,read:string,meant:string>"


def _aligned(held):
    """``n, own, options`` of unknown words: their likelihood as they stand, and the confusions that would explain them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(held)
        kind = pa.list_(pa.struct([("base", pa.float64()), ("kind", pa.string()), ("read", pa.string()), ("meant", pa.string())]))
        for batch in batches:
            n, own, options = [], [], []
            for w, k in zip(*(c.to_pylist() for c in batch.columns)):
                got = [{"base": q + AFTER[0, 0], "kind": e[0], "read": e[1], "meant": e[2]} for c, e in model.options(w) if (q := model.known(c)) is not None]
                if got:
                    n.append(k)
                    own.append(model.as_unknown(w) + AFTER[0, 1])
                    options.append(got)
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(own, pa.float64()), pa.array(options, kind)], ["n", "own", "options"])

    return run


def _expected(held):
    """``read, meant, n, sound``: how many of each confusion the channel as it is expects behind the unknown words, and as many
    as it would expect by chance, from the sound ones (with a negative ``n``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(held)
        for batch in batches:
            c: Counter[tuple[str, str]] = Counter()
            chance: Counter[tuple[str, str]] = Counter()
            for n, own, options in zip(*(x.to_pylist() for x in batch.columns)):
                weight = [math.exp(min(700.0, o["base"] + model.cost(o["kind"], o["read"], o["meant"]) - own)) for o in options]
                for o, x in zip(options, weight):
                    (c if n > 0 else chance)[o["read"], o["meant"]] += x / (1 + sum(weight))  # a confusion shows in many words, a name in one
            keys = [*{**c, **chance}]
            cols = [pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)] + [pa.array([x[k] for k in keys], pa.float64()) for x in (c, chance)]
            yield pa.RecordBatch.from_arrays(cols, ["read", "meant", "n", "sound"])

    return run


def learned(model: Model, src: DataFrame) -> Model:
    """``model`` with a channel estimated from the scanned texts ``src`` by expectation maximisation.

    Only distinct unknown words are aligned, once; each round passes over their alignments without a shuffle but for the sums.
    Names resemble other names without being misread, so what the rare words of sound texts would give, scaled to the
    scanned ones, and two deviations of it, is taken off. What comes to the driver are the confusions that this leaves, expected at
    least in two words each: at most half as many as there are unknown scanned words, in practice some hundred.
    """
    context = src.sparkSession.sparkContext
    held = _Held(context.broadcast(model.parts()))
    words = checkpoint(src.mapInArrow(_unknown(held), "w string, n long").groupBy("w").agg(F.sum("n").alias("n")))
    model.scanned = (words.where("w = ''").agg(F.sum("n")).head()[0]) or 0
    sound = model.rare.select("w", (-F.col("n")).alias("n"))
    aligned = checkpoint(words.where("w <> ''").unionByName(sound).mapInArrow(_aligned(held), f"n long, own double, options array<{_OPTION}>"))
    chance = F.col("sound") * (model.scanned / model.total)
    for _ in range(ROUNDS):
        held = _Held(context.broadcast(model.parts()))
        sums = aligned.mapInArrow(_expected(held), "read string, meant string, n double, sound double").groupBy("read", "meant").agg(F.sum("n").alias("n"), F.sum("sound").alias("sound"))
        sums = sums.select("read", "meant", (F.col("n") - chance - 2 * F.sqrt(chance)).alias("n"))
        model.edits = {(r.read, r.meant): r.n for r in sums.where("n >= 2").collect()}
    return model


def _pairs_needed(held):
    """``key, a, b``: the word pairs between which the decoding of a row may choose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(held)
        for batch in batches:
            rows = [(k, a, b) for k, p, q, h in zip(*(c.to_pylist() for c in batch.columns)) for a, b in {x for t in (p, q) if t for x in unsure(t, _grams(h), model)}]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["key", "a", "b"])

    return run


def pair_counts(items: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``a, b, n`` of those of the ``n`` pairs ``wanted`` (``a, b``) that the corpus has."""
    words = F.filter(F.transform(F.split(F.concat_ws(" ", "passage", "question"), r"\s+"), lambda t: F.btrim(t, F.lit(EDGE))), lambda t: t != "")
    pairs = clean_texts(items).select(words.alias("ws")).where(F.size("ws") > 1)
    pairs = pairs.select(F.explode(F.expr("arrays_zip(slice(ws, 1, size(ws) - 1), slice(ws, 2, size(ws) - 1))")).alias("p")).toDF("p").select(F.col("p.0").alias("a"), F.col("p.1").alias("b"))
    return pairs.join(broadcast_if_small(wanted, n), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("n"))


def _mended(items: DataFrame, pages: DataFrame, run, schema: str, id_col: str) -> DataFrame:
    src = items.select(F.col(id_col).alias("item_id"), "passage", "question", F.col("metadata.source_file").alias("source_file"))
    src = src.where(is_pdf("source_file") & (F.col("passage").isNotNull() | F.col("question").isNotNull()))
    heads = checkpoint(heads_of(pages.select("source_file", "text").where("source_file is not null")))
    src = src.join(broadcast_if_small(heads, heads.count(), 100_000), "source_file", "left").select(F.xxhash64("passage", "question", "source_file").alias("key"), "item_id", "passage", "question", "heads")
    model = learned(model_of(items), src.select("item_id", "passage", "question", "heads"))
    held = _Held(items.sparkSession.sparkContext.broadcast(model.parts()))
    needed = checkpoint(src.select("key", "passage", "question", "heads").mapInArrow(_pairs_needed(held), "key long, a string, b string").distinct())
    wanted = checkpoint(needed.select("a", "b").distinct())
    counted = checkpoint(pair_counts(items, wanted, wanted.count()))
    of_row = needed.join(broadcast_if_small(counted, counted.count()), ["a", "b"]).groupBy("key").agg(F.collect_list(F.struct("a", "b", "n")).alias("pairs"))  # the pairs of one text
    of_row = checkpoint(of_row)
    src = src.join(broadcast_if_small(of_row, of_row.count(), 20_000), "key", "left").select("item_id", "passage", "question", "heads", "pairs")
    return src.mapInArrow(run(held), schema)


_MODELS: dict[int, Model] = {}


def _model(held) -> Model:
    if held.id not in _MODELS:
        _MODELS.clear()
        _MODELS[held.id] = Model(*held.value)
    return _MODELS[held.id]


class _Held:
    """A broadcast with a key under which a worker remembers what it made of it."""

    def __init__(self, broadcast) -> None:
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    @property
    def value(self):
        return self.broadcast.value

    def __reduce__(self):
        return _held, (self.broadcast, self.id)


def _held(broadcast, key) -> _Held:
    out = _Held.__new__(_Held)
    out.broadcast, out.id = broadcast, key
    return out


def _pairs_of(rows: list[dict] | None) -> dict[tuple[str, str], int]:
    return {(r["a"], r["b"]): r["n"] for r in rows or []}


def noise(items: DataFrame, pages: DataFrame, id_col: str = "item_id") -> DataFrame:
    """``item_id, field, noise``: each kind of noise in each field of the items from PDF files, once.

    The model is counted over all items in one aggregation and its channel estimated from the distinct unknown words of the
    scanned texts. Word pairs are counted only where the decoding needs them, and go to the rows by a join. The heads of
    the files are broadcast if there are few. Null and blank fields have no noise, items without a
    file aren't from one, files without pages are judged by the form of their lines. Second deliveries add nothing.
    """
    item = items.schema[id_col].dataType.simpleString()

    def run(held):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = _model(held)
            for batch in batches:
                rows = []
                for i, p, q, h, n in zip(*(c.to_pylist() for c in batch.columns)):
                    heads, pairs = _grams(h), _pairs_of(n)
                    rows += [(i, f, k) for f, t in (("passage", p), ("question", q)) if t for k in mend(t, heads, model, pairs)[0]]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["item_id", "field", "noise"])

        return go

    return _mended(items, pages, run, f"item_id {item}, field string, noise string", id_col).distinct()


def repaired(items: DataFrame, pages: DataFrame, id_col: str = "item_id") -> DataFrame:
    """``item_id, passage, question`` of the items from PDF files as continuous, corrected paragraphs; null fields stay null."""
    item = items.schema[id_col].dataType.simpleString()

    def run(held):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = _model(held)
            for batch in batches:
                heads, pairs = [_grams(h) for h in batch.column(3).to_pylist()], [_pairs_of(n) for n in batch.column(4).to_pylist()]
                cols = [pa.array([None if t is None else mend(t, h, model, n)[1] for t, h, n in zip(batch.column(k).to_pylist(), heads, pairs)], pa.string()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["item_id", "passage", "question"])

        return go

    return _mended(items, pages, run, f"item_id {item}, passage string, question string", id_col)
