"""Defects of question-response pairs (problem 4).

The response of an item is the choice its ``answer`` points to together with its ``explanation``. A pushdown parser
over brackets, quotation marks, fences and markup finds what an explanation left open, greedy string tiling what it only
repeats of the question and choices, script counts its language, and a small grammar of courtesy and inability its
refusals. Each item has at most one defect; they are tried in the order of ``DEFECTS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFECTS = ("empty", "refusal", "copied", "wrong_language", "truncated")

# Stand-ins for nothing, after case folding and without signs and spaces.
NOTHING = set(
    "해설없음 풀이없음 설명없음 해설이없음 내용없음 내용이없음 답없음 정답없음 없음 없습니다 해설미제공 미제공 미정 미입력 해당없음 준비중 추후제공 생략 해설 풀이 설명 답변 "
    "na none null nil nan undefined empty blank tbd todo noexplanation notavailable notapplicable noanswer explanation answer なし 無し 解説なし 无 無 暂无".split()
)
LABEL = regex.compile(r"^\s*(?:\d{1,2}\s*[.)]\s*)?(?:\[?(?:문제|질문|문항|물음|답변|응답|해설|풀이|설명|question|answer|explanation|q|a)\]?\s*[:：.)]\s*)", regex.I)
NUMBER = r"[(（\[]?\s*(?:[①-⑳]|[1-9]\d?\s*번?|[A-Ea-e](?![A-Za-z]))\s*[)）\]]?"
NAMES = regex.compile(
    rf"^(?:따라서|그러므로|해설|풀이)?[\s:：,]*(?:(?:the\s+)?(?:correct\s+)?answer\s*(?:is|:)?|정답|답|정답 번호)?\s*[은는:：]?\s*{NUMBER}\s*(?:번|이다|다|입니다|임|이에요|예요|이\s*적절함|가\s*적절함)?\s*[.。]?\s*(?:[(（][^()（）]*[)）])?\s*[.。]?$",
    regex.I,
)
TAIL_ANSWER = regex.compile(rf"[\s(（]*(?:(?:따라서|그러므로|so|therefore),?\s*)?(?:(?:the\s+)?answer\s*(?:is)?|정답|답)\s*[은는:：]?\s*{NUMBER}\s*(?:이다|입니다|번)?\s*[)）]?[.。]?\s*$", regex.I)
QUOTED = regex.compile(r"\"[^\"\n]*\"|“[^”\n]*”|‘[^’\n]*’|「[^」\n]*」|『[^』\n]*』|(?<![A-Za-z])'[^'\n]*'(?![A-Za-z])")
INVISIBLE = regex.compile(r"[\p{Cf}\p{Cc}--[\n\t]]|&(?:nbsp|zwnj|zwj|ensp|emsp);|<br\s*/?>", regex.V1)

# A refusal: an object of help, then inability or unwillingness in the polite or first person. Plain statements that
# something can't be done or said are ordinary prose and don't match.
OBJECT = r"(?:답|풀이|풀어|해설|설명|골라|도와|도움|알려|제공|제시|처리|진행|응답|안내|말씀|요청|물음|질문|문항|의견|대화)"
UNABLE = (
    r"(?:(?:드릴|해드릴|할|낼)\s*수\s*(?:가\s*)?없(?:습니다|어요|네요|음|는 점|겠)|드리기(?:가|는|에는)?\s*(?:어렵|곤란|힘들|불가)|(?:드리지|하지|주지)\s*못(?:합니다|해요|함|하는 점|하겠)"
    r"|[가-힣]지(?:는)?\s*않(?:습니다|아요|음|겠습니다|을게요|도록 (?:되어|설계|정해))|삼가(?:겠습니다|합니다|고자|려고|도록)|(?:사양|거절|사절)(?:하겠습니다|합니다|할게요)"
    r"|권한\s*(?:밖|이 없)|(?:어렵|곤란|불가능)(?:합니다|습니다|해요|하겠))"
    r"(?!\s*[.!]?[\"'”’」』]?\s*(?:라고|라는|라며|라면서|라 |고\s|며\s))"  # what is reported of somebody
)
#: Somebody else than the speaker of the explanation, as the subject of a sentence.
THIRD = r"(?<![가-힣])(?:(?:이|그|저|한|위|해당)\s)?(?:인물|필자|글쓴이|저자|작가|화자|주인공|학생|독자|청자|그녀?|사람|정부|회사|아이|선생님|[가-힣]{2,4}\s?씨)(?:들)?(?:은|는|이|가|께서)\s"
ABOUT_OTHERS = regex.compile(rf"(?:^|(?<=[.!?\n]))[^.!?\n]*?{THIRD}[^.!?\n]*")
APOLOGY = r"(?:죄송(?:하지만|합니다만|스럽지만|하오나)|송구(?:하지만|스럽지만|합니다만)|미안(?:하지만|합니다만)|유감(?:스럽게도|이지만)|안타깝(?:게도|지만)|아쉽(?:게도|지만)|말씀은 감사(?:하지만|합니다만)|저(?:로서)?는)"
REFUSALS = regex.compile(
    rf"{OBJECT}[^.!?\n]{{0,40}}?{UNABLE}|{APOLOGY}[^.!?\n]{{0,60}}?{UNABLE}"
    r"|\bI(?:'m| am)\s+(?:\w+\s+)?(?:unable|not able)\b|\bI(?:'m| am)\s+(?:\w+\s+)?(?:sorry|afraid)(?:\s*[.!]|,?\s+but\b|,?\s+(?:that\s+)?(?:I|we|this|it)\b[^.!?\n]{0,60}?(?:can(?:no|')t|can not|cannot|unable|not able|won't|will not|decline))|\bI\s+(?:can(?:no|')t|can not|won't|will not|must decline|decline to)\s+(?:\w+\s+)?(?:answer|help|assist|provide|solve|explain|do|give|choose|tell|comply)"
    r"|\bas an? (?:AI|language model)\b|\b(?:unable|not able) to (?:answer|help|assist|provide|solve|explain|give|choose)\b"
    r"|(?:お答え|回答|説明|お手伝い|解説|提供)(?:は|を|が|する(?:こと)?(?:は|が))?\s*(?:でき(?:ません|かねます)|致しかねます)|申し訳(?:ありません|ございません)"
    r"|(?:无法|不能|無法)(?:为您|為您)?(?:回答|提供|帮助|幫助|解答|协助|给出)|(?:抱歉|对不起)[，,]",
    regex.I,
)
HINT = regex.compile(r"드릴|드리|않겠|않을게|않도록|삼가|사양|거절|해 ?드|없습|없어요|없네요|없음|않습|않아|권한|곤란|어렵|불가|못합|못해|sorry|can.?no?t|AI|unable|decline|ません|かね|無法|无法|不能|抱歉", regex.I)

WORD = regex.compile(r"[^\p{L}\p{Nd}]+")
HANGUL, LATIN, KANA, HAN = (regex.compile(p) for p in (r"[가-힣]", r"\p{Latin}", r"[ぁ-ゖァ-ヺ]", r"\p{Han}"))
OPEN = dict(zip("([{「『“‘〈《【（［｛", ")]}」』”’〉》】）］｝", strict=True))
CLOSE = set(OPEN.values())
_NUMBER = r"[-+−]?(?:\d[\d.,]*|∞|[a-zA-Zπ]|-?infty)"
#: What the pushdown parser reads; intervals may be half open and are read whole.
SYNTAX = regex.compile(
    rf"(?P<interval>[\[(]\s*{_NUMBER}\s*,\s*{_NUMBER}\s*[\])])|(?P<fence>```)|(?P<formula>\$\$)|(?P<quote>\")|(?P<open>[" + regex.escape("".join(OPEN)) + "])|(?P<close>[" + regex.escape("".join(CLOSE)) + "])"
    r"|(?P<tag><(?P<slash>/?)(?P<name>b|i|u|em|strong|p|div|span|ul|ol|li|table|tr|td|th|code|pre|sup|sub|blockquote)\b[^<>]*>)|(?P<item>\n[ \t]*(?:[-*•·▪◦※]|\(?\d{1,2}[.)])[ \t]*\Z)",
    regex.I,
)
VOID_TAGS = {"p", "li", "td", "tr", "th"}
ENDS = ".!?。！？"
KO_END = regex.compile(
    r"(?:[가-힣]다|(?:어|아|에|예|네|지|죠|세|해|군|려|워|와|돼|여|까|데|은가|는가|던가)요|니까|ㄹ까|을까|일까|는가|은가|인가|절함|당함|능함|요함|일함|치함|[가-힣]{2}함|맞음|옳음|틀림|있음|없음|같음|않음|았음|었음|했음|였음|됨|것임|이다|시오|세요|어라|아라)$"
)
LIST_ITEM = regex.compile(r"^\s*(?:[-*•·▪◦※]|\(?\d{1,2}[.)]|[①-⑳ㄱ-ㅎ㉠-㉭가-하][.)]?)\s+\S")


def clean(text: str | None) -> str:
    """``text`` without signs that show nothing."""
    if not text:
        return ""
    return INVISIBLE.sub(lambda m: " " if m.group()[0] in "&<" else "", text).strip()


def letters(text: str) -> str:
    return WORD.sub("", text).casefold()


def says_nothing(text: str) -> bool:
    """``text`` (cleaned) is blank, signs alone, a bare label or a stand-in for nothing."""
    return len(text) < 40 and ((x := letters(text)) == "" and not regex.search(r"[①-⑳]", text) or x in NOTHING)


def points_to_text(choices: list[str | None] | None, answer: int | None) -> bool:
    return bool(choices and answer is not None and 1 <= answer <= len(choices) and regex.search(r"[^\p{Z}\p{C}\s]", clean(choices[answer - 1])))


def language(text: str) -> str:
    """ko, ja, zh or en by the script that carries most of ``text``; '' without letters or without a clear majority."""
    kana, han = len(KANA.findall(text)), len(HAN.findall(text))
    n = {"ko": 2.2 * len(HANGUL.findall(text)), "en": float(len(LATIN.findall(text)))}
    if kana * 8 >= han:
        n["ja"] = 2.2 * (kana + han) if kana else 0.0
    else:
        n["zh"] = 2.5 * han
    total, best = sum(n.values()), max(n, key=lambda k: n[k])
    return best if total and n[best] >= 0.6 * total else ""


def _automaton(source: str) -> tuple[list[dict[str, int]], list[int], list[int], list[int]]:
    """The suffix automaton of ``source``: transitions, suffix links, longest lengths and an end of each state."""
    to: list[dict[str, int]] = [{}]
    link, size, end, last = [-1], [0], [0], 0
    for at, c in enumerate(source):
        new = len(to)
        to.append({})
        link.append(0)
        size.append(size[last] + 1)
        end.append(at + 1)
        p, last = last, new
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                half = len(to)
                to.append(dict(to[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                end.append(end[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = half
                    p = link[p]
                link[q] = link[new] = half
    return to, link, size, end


def maximal(text: str, source: str) -> list[tuple[int, int, int]]:
    """``length, start, place``: the common stretches of ``text`` and ``source`` that can't be made longer, in time in
    proportion to both, by running ``text`` through the suffix automaton of ``source``."""
    to, link, size, end = _automaton(source)
    out, state, n = [], 0, 0
    for i, c in enumerate(text):
        if c not in to[state]:
            out.append((n, i - n, end[state] - n))
            while state and c not in to[state]:
                state = link[state]
                n = size[state]
            if c not in to[state]:
                state = n = 0
                continue
        state, n = to[state][c], n + 1
    out.append((n, len(text) - n, end[state] - n))
    return [x for x in out if x[0]]


def tile(text: str, sources: list[str], least: int = 4) -> tuple[str, list[bool]]:
    """Greedy string tiling: what no tile of at least ``least`` signs from ``sources`` covers, and the covered signs of ``sources[0]``.

    Tiles are placed longest first, of equal ones the first; signs of ``text`` that a tile covers are marked, and a
    stretch that runs into marked signs goes back with what is left of it. The marks of the sources are lifted after each
    tile, as a text that repeats a source twice adds nothing either; ``covered`` keeps them all.
    """
    source = "\0".join(sources)
    covered = [False] * len(sources[0]) if sources else []
    marked = bytearray(len(text) + 1)
    marked[len(text)] = 1
    heap = [(-n, i, j) for n, i, j in maximal(text, source) if n >= least]
    heapify(heap)
    while heap:
        n, i, j = heappop(heap)
        start = marked.find(0, i, i - n)
        if start < 0:
            continue
        stop = min(marked.find(1, start), i - n)
        if stop - start < -n:  # a part of it is marked by now
            if stop - start >= least:
                heappush(heap, (start - stop, start, j + start - i))
            if i - n - stop > least:
                heappush(heap, (stop - i + n, stop, j + stop - i))
            continue
        marked[start:stop] = b"\1" * (stop - start)
        if j < len(covered):
            covered[j : j - n] = [True] * min(-n, len(covered) - j)
    return "".join(c for c, m in zip(text, marked) if not m), covered


def copies(text: str, question: str, choices: list[str | None] | None) -> bool:
    """``text`` is the question, perhaps reworded at its end, repeated or with the choices, and nothing else."""
    body = text
    while (m := LABEL.match(body)) and m.end() < len(body):
        body = body[m.end() :]
    q, a = letters(question), letters(body)
    if len(q) < 4 or len(a) < 4:
        return False
    step = max(1, (len(q) - 4) // 8 or 1)
    probes = [q[i : i + 4] for i in range(0, len(q) - 3, step)]
    if sum(p in a for p in probes) * 2 < len(probes):
        return False
    rest, covered = tile(a, [q, *(c for x in choices or [] if x and (c := letters(x)))])
    if sum(covered) < 0.6 * len(q) or regex.search("정답|답은|answer", rest):
        return False
    return len(rest) <= max(8, 0.12 * len(a))


def leaves_open(text: str) -> bool:
    """The pushdown parser: something in ``text`` is opened and never closed: a bracket, quotation, fence, formula, tag or the
    item of a list.

    Within a fence or formula only its end counts. A closing sign closes what it matches, with all that stands open inside;
    one that matches nothing is a sign like others. Intervals, and the marks of feet, inches, minutes and apostrophes, are no brackets or quotations.
    """
    stack: list[str] = []
    for m in SYNTAX.finditer(text):
        kind, s = m.lastgroup, m.group()
        top = stack[-1] if stack else ""
        if top in ("```", "$$"):
            if kind in ("fence", "formula") and s.strip() == top:
                stack.pop()
        elif kind in ("fence", "formula"):
            stack.append(s.strip())
        elif kind == "open":
            stack.append(OPEN[s])
        elif kind == "quote" and s in stack or kind == "close" and s in stack:
            while stack.pop() != s:
                pass
        elif kind == "quote" and not (m.start() and text[m.start() - 1].isdigit()):
            stack.append(s)
        elif kind == "tag":
            name = m.group("name").lower()
            if name in VOID_TAGS:
                continue
            if not m.group("slash"):
                stack.append(f"<{name}>")
            elif f"<{name}>" in stack:
                while stack.pop() != f"<{name}>":
                    pass
        elif kind == "item":
            stack.append("item")  # the last line is a bare mark
    return bool(stack)


def breaks_off(text: str) -> bool:
    """``text`` (cleaned, not blank) ends before its last sentence does. A missing full stop alone doesn't count."""
    if leaves_open(text):
        return True
    end = text.rstrip(" \n\t\"'”’」』)]}）*_~`")
    if not end:
        return False
    stem = end.rstrip("….") if end.endswith(("...", "…", "..")) else end
    if stem == end and end[-1] in ENDS:
        return False
    if not stem or (stem == end and end[-1] in ",;:·-–—(/&、，"):
        return True
    if stem[-1] in "!?。！？":
        return False
    if NAMES.match(stem.rsplit("\n", 1)[-1].strip()) or TAIL_ANSWER.search(stem):
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1 and LIST_ITEM.match(lines[-1]) and LIST_ITEM.match(lines[-2]) and not lines[-2].rstrip().endswith(tuple(ENDS)):
        return False
    word = stem.split()[-1]
    if HANGUL.search(word[-1]):
        return not KO_END.search(word)
    return word[-1].isalpha() or not word[-1].isalnum()


def defect(question: str | None, choices: list[str | None] | None, answer: int | None, explanation: str | None) -> str | None:
    """The defect of one item, or none."""
    x = clean(explanation)
    if says_nothing(x):
        return None if points_to_text(choices, answer) else "empty"
    if len(x) < 60 and NAMES.match(x):
        return None
    bare = QUOTED.sub(" ", x)
    if HINT.search(bare) and REFUSALS.search(ABOUT_OTHERS.sub(" ", bare)):
        return "refusal"
    q = clean(question)
    if copies(x, q, choices):
        return "copied"
    said, asked = language(TAIL_ANSWER.sub("", bare if letters(bare) else x)), language(q)
    if said and asked and said != asked:
        return "wrong_language"
    return "truncated" if breaks_off(x) else None


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, found = [], []
        for i, q, c, a, x in zip(*(col.to_pylist() for col in batch.columns)):
            if d := defect(q, c, a, x):
                ids.append(i)
                found.append(d)
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(found, pa.string())], ["item_id", "defect"])


def defects(df: DataFrame, id_col: str = "item_id", question: str = "question", choices: str = "choices", answer: str = "answer", explanation: str = "explanation") -> DataFrame:
    """``item_id, defect`` of each defective item, each once.

    One narrow pass over five columns; only the defective rows are shuffled, to drop second deliveries. Nulls anywhere
    are allowed: a null question is compared with nothing, null choices or an answer outside them point to no text. An
    empty table gives an empty one; texts are read whole; other columns are ignored.
    """
    src = df.select(F.col(id_col).alias("item_id"), F.col(question).alias("question"), F.col(choices).alias("choices"), F.col(answer).cast("int").alias("answer"), F.col(explanation).alias("explanation"))
    return src.mapInArrow(_judge, f"item_id {src.schema['item_id'].dataType.simpleString()}, defect string").distinct()
