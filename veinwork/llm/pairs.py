"""Defective prompt and response pairs.

Copies are found by compressing the response with the prompt as a zstandard dictionary
and the other way round: the bytes that either costs beyond a repetition are what it says
of its own. Language and refusal dictionaries give two further labels. Whether an answer breaks off is judged by a
terminal-context model: over all prompts and responses it is counted how often each
final context of up to five words ends a sentence or line and how often text goes on.

Labels in this order, one for a pair: empty, copies_prompt, refusal, truncated,
wrong_language. Defined cases: a null response is empty; a null or blank prompt has no
language and can't be copied; pairs delivered twice give one row; other columns are
not read; texts of any length are read whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinwork.session import bounded, spread

# Answers that are none, compared in lower case without white space at the ends.
NO_ANSWER = ["n/a", "n.a.", "na", "null", "nil", "nan", "undefined", "tbd", "todo", "[]", "{}", "()", "\"\"", "''", "<empty>", "[empty]",
             "(empty)", "no answer", "no response", "[no response]", "empty"]
# Labels before an answer.
LABEL = re.compile(r"^(?:(?:answer|response|reply|question|prompt|assistant|user|output|q|a|antwort|frage|réponse|respuesta|pregunta|question|回答|答案|问题)\s*[:：]\s*)+", re.I)
# How a refusal begins, and what it says it can't do.
REFUSAL_OPENING = re.compile(r"^\W*(?:this is something|that is something|das ist etwas|c['’]est quelque chose|esto es algo|sorry|i['’]?m\b|i am\b|i\b|as an? (?:ai|language|large)|unfortunately|apolog|es tut mir leid|tut mir leid|leider|als (?:ki|sprachmodell|künstliche)|"
                             r"ich\b|je\b|désolé|désolée|malheureusement|en tant que?|lo siento|lamento|lamentablemente|desafortunadamente|perdón|como\b|no puedo|no me es|"
                             r"mi dispiace|mi spiace|purtroppo|non posso|sono spiacente|in quanto|come (?:ia|modello|assistente)|desculpe|desculpa|lamento|infelizmente|não posso|sinto muito|eu\b|het spijt me|helaas|sorry|ik kan\b|als ai|"
                             r"抱歉|很抱歉|对不起|作为|我无法|我不能|不好意思)", re.I)
REFUSAL_CORE = re.compile(r"\b(?:i|i['’]m|i am|is something i['’]m|we)\s+(?:(?:really|just|simply)\s+)?(?:cannot|can['’]?t|can not|won['’]?t|will not|am not able|(?:am )?not able|(?:am )?unable|must decline|have to decline|must refuse|decline|refuse|am not allowed|am not permitted)\b|\bunable to (?:discuss|help|assist|answer|provide)\b|"
                          r"\b(?:kann|darf|möchte|werde) ich\b.*\bnicht\b|\bich (?:kann|darf|möchte|werde)\b.*\bnicht\b|\b(?:muss ich|ich muss)\b.*\bablehnen\b|\bnicht in der lage\b|"
                          r"\bje ne (?:peux|puis|suis) pas\b|\b(?:il m['’]est|m['’]est) impossible\b|\bje dois (?:refuser|décliner)\b|\bpas en mesure\b|"
                          r"\bno (?:puedo|podré|podemos)\b|\bno me es posible\b|\bno estoy (?:autorizado|en condiciones)\b|\bdebo (?:rechazar|declinar)\b|\bme es imposible\b|"
                          r"\bnon (?:posso|sono in grado|mi è possibile)\b|\bdevo (?:rifiutare|declinare)\b|\bnão (?:posso|consigo|estou (?:autorizado|em condições)|me é possível)\b|\b(?:preciso|devo|tenho de) (?:recusar|declinar)\b|"
                          r"\bik kan\b.*\b(?:niet|geen)\b|\bkan ik\b.*\b(?:niet|geen)\b|\bniet in staat\b|\bmoet ik weigeren\b|"
                          r"无法(?:回答|提供|协助|帮助|完成|满足|讨论|处理|解释)|不能(?:回答|提供|协助|帮助|完成|满足|讨论)|无能为力|拒绝回答", re.I)
# What the sentences after a refusal speak of: the speaker, who asks, and other help.
REFUSAL_COMPANY = re.compile(r"\b(?:i|i['’]m|my|me|you|your|assistant|language model|policy|policies|guidelines?|ich|mir|mich|mein\w*|sie|ihnen|ihre?\w*|du|dir|je|me|moi|mes|vous|votre|vos|tu|yo|mi|mis|usted|le|su|te|"
                             r"io|mio|lei|voi|eu|meu|você|ik|mijn|u|uw|je|jij)\b|我|您|你|助手|模型", re.I)
# Frequent words of each language that tell it from the others.
WORDS = {
    "en": "the of and to in is that it for with as on by this was are be from at which when how what between because only not under does into after within our we if their has",
    "de": "der die das und ist nicht ein eine den von mit auf für dem sich auch wie des im zu nach erst als oder wird sind bei ob noch nur haben zum zur dass wir",
    "fr": "le la les des et est dans une un que pour du pas sur au avec ce par plus se qui ne sont aux mais encore non alors lorsque depuis ainsi nous leur cette après",
    "es": "el la los las de y que en un una es por con para del se al lo como más pero sus no sino además cuando desde así mientras después esta este entre también según",
    "it": "il lo gli di che è per con del della nel sono non anche più come una questo dopo quando mentre tra ma si al dei delle",
    "pt": "o os um uma de que em não do da no na para com por mais como mas ao das dos se é também quando após entre são",
    "nl": "de het een en van is dat op te zijn met voor niet aan er ook bij als maar om dan nog naar wordt door over deze tussen",
}
LANGUAGE_OF = {w: [l for l, ws in WORDS.items() if w in ws.split()] for ws in WORDS.values() for w in ws.split()}
# Names of languages as prompts ask for them.
ASKED = {"en": r"english|englisch|auf englisch|anglais|inglés|英语|英文", "de": r"german|deutsch|allemand|alemán|德语|德文", "fr": r"french|französisch|français|francés|法语|法文",
         "es": r"spanish|spanisch|espagnol|español|castellano|西班牙语|西班牙文", "zh": r"chinese|chinesisch|chinois|chino|中文|汉语", "it": r"italian|italienisch|italien|italiano", "pt": r"portuguese|portugiesisch|portugais|portugués", "nl": r"dutch|niederländisch|néerlandais|holandés"}
ASKED_RE = {k: re.compile(rf"(?<!\w)(?:{v})(?!\w)" if k != "zh" else rf"(?:{v})", re.I) for k, v in ASKED.items()}
_REQUEST = re.compile(r"\((?:please\s+)?(?:answer|respond|reply|bitte|réponds?|répondez|responda|conteste)[^)]*\)", re.I)

_INVISIBLE = dict.fromkeys([*range(0x200B, 0x2010), 0x2060, 0xFEFF, 0xAD])
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+(?:[.,]\d+)*|\n|[^\w\s]", re.U)
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_END = set(".!?。！？…")
_CLOSERS = "\"'”’»)]*_` \t\n\r"


def visible(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "").translate(_INVISIBLE).strip()


def is_empty(text: str | None) -> bool:
    """No answer in it: nothing visible, signs only, or a word for nothing."""
    t = LABEL.sub("", visible(text)).strip()
    return not re.search(r"\w", t) or re.sub(r"^`+\w*\s*|\s*`+$", "", t.lower()).strip(" .") in NO_ANSWER or not re.search(r"\w", re.sub(r"^```\w*", "", t))


def _plain(text: str) -> str:
    return " ".join(re.findall(r"\w+", LABEL.sub("", visible(text)).casefold()))


def cost(dictionary: bytes, text: bytes, level: int = 1) -> int:
    """Bytes of the text compressed with a zstandard dictionary."""
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(text))


def novelty(known: str, text: str) -> int:
    """Bytes that the text costs beyond those of a mere repetition, with what is known as dictionary."""
    k, t = known.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
    return max(0, cost(k, t) - cost(t, t))


def copies_prompt(prompt: str | None, response: str, most_novel: float = 0.12, one_stretch: int = 3, least_part: float = 0.5) -> bool:
    """Nothing but the prompt: neither says anything that isn't in the other, or the response is one long stretch of it.

    most_novel is the share of its own bytes that a text may cost beyond a repetition;
    one_stretch the bytes beyond which a response isn't one piece of the prompt.
    """
    p, r = _plain(prompt or ""), _plain(response)
    if len(p) < 8 or len(r) < 8:
        return False
    new = novelty(p, r)
    if new > max(one_stretch, most_novel * len(r.encode("utf-8", "surrogatepass"))):
        return False
    if new <= one_stretch and len(r) >= least_part * len(p):
        return True
    return novelty(r, p) <= most_novel * len(p.encode("utf-8", "surrogatepass"))


def is_refusal(response: str, least_share: float = 0.5) -> bool:
    """Opens like a refusal, says so in its first two sentences, and doesn't go on to an answer.

    What follows counts by its signs: at least least_share of it must stand in sentences
    about the speaker, the request or other help.
    """
    t = LABEL.sub("", visible(response))
    if not REFUSAL_OPENING.search(t):
        return False
    parts = [x for x in re.split(r"(?<=[.!?])\s+|(?<=[。！？])\s*|\n+", t) if x.strip()]
    if not REFUSAL_CORE.search(" ".join(parts[:2])):
        return False
    rest = parts[2:]
    about = sum(len(x) for x in rest if REFUSAL_COMPANY.search(x) or REFUSAL_CORE.search(x))
    return about >= least_share * sum(map(len, rest))


def language(text: str, least: int = 3, learned: dict[str, str] | None = None) -> str | None:
    """Language of a text by the words that tell it, or None if too few do; learned words are asked where these don't."""
    n_cjk = len(_CJK.findall(text))
    words = re.findall(r"[^\W\d_]+", text.lower())
    if n_cjk >= 5 and n_cjk > 0.2 * len(text):
        return "ja" if re.search(r"[぀-ヿ]", text) else "zh"
    for lang, script in (("ru", r"[а-яё]"), ("ar", r"[؀-ۿ]"), ("ko", r"[가-힯]"), ("el", r"[α-ω]")):
        if len(re.findall(script, text.lower())) > 0.4 * max(1, sum(map(len, words))):
            return lang
    votes: Counter = Counter()
    for w in words:
        for l in LANGUAGE_OF.get(w, ()):
            votes[l] += 1 / len(LANGUAGE_OF[w])
    for more in (None, learned):
        if more:
            votes.update(more[w] for w in words if w in more)
        if votes:
            (best, n), *rest = votes.most_common(2)
            if n >= least and (not rest or n >= 1.3 * rest[0][1]):
                return best
    return None


def learned_words(rows: DataFrame, per_language: int = 3000, least: int = 5, least_share: float = 0.95) -> dict[str, str]:
    """The language of words that stand in texts of one language, which all prompts and responses teach; a bounded list for each language."""

    def teach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: Counter = Counter()
            for t in (t for col in ("prompt", "response") for t in b[col] if t):
                l = language(visible(t), 4)
                if l in WORDS:
                    n.update((w, l) for w in set(re.findall(r"[^\W\d_]+", t.lower())) if w not in LANGUAGE_OF)
            if n:
                yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["word", "lang", "n"])

    counted = rows.mapInPandas(teach, "word string, lang string, n bigint").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    sure = counted.groupBy("word").agg(F.max_by("lang", "n").alias("lang"), F.max("n").alias("most"), F.sum("n").alias("n")).filter((F.col("n") >= least) & (F.col("most") >= least_share * F.col("n")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return {r.word: r.lang for r in sure.withColumn("place", place).filter(F.col("place") <= per_language).select("word", "lang").collect()}


def wrong_language(prompt: str | None, response: str, learned: dict[str, str] | None = None) -> bool:
    """Neither in the language of the prompt nor in one it names."""
    p = visible(prompt)
    t = visible(response)
    if not p or t[:1] in "{[" or t.startswith("```"):
        return False
    got = language(t, learned=learned)
    of_prompt = language(_REQUEST.sub(" ", p), least=1, learned=learned)
    if got is None or of_prompt is None or got == of_prompt:
        return False
    asked = [l for l, r in ASKED_RE.items() if r.search(p)]
    return got not in asked


def broken_json(response: str) -> bool | None:
    """Whether an answer that opens as JSON breaks off; None if it isn't JSON."""
    t = visible(response)
    fenced = t.startswith("```")
    if fenced:
        t = re.sub(r"^```\w*\s*", "", t)
    if t[:1] not in ("{", "["):
        return None
    body = re.sub(r"\s*```$", "", t)
    try:
        json.loads(body)
        return fenced and body == t
    except ValueError:
        depth, quoted, skip = 0, False, False
        for ch in body:
            if skip:
                skip = False
            elif ch == "\\":
                skip = quoted
            elif ch == '"':
                quoted = not quoted
            elif not quoted and ch in "{[":
                depth += 1
            elif not quoted and ch in "}]":
                depth -= 1
        return quoted or depth > 0


def tokens(text: str) -> list[str]:
    """Words in lower case, numbers as one sign, each ideograph by itself, line ends and punctuation."""
    out = []
    for t in _TOKEN.findall(unicodedata.normalize("NFKC", text).translate(_INVISIBLE)):
        if t[0].isdigit():
            out.append("#")
        elif _CJK.search(t):
            out += list(t)
        else:
            out.append(t.lower())
    return out


ORDER = 5
#: A one-line answer of so few words is whole.
SHORT = 3
_ITEM = re.compile(r"\s*(?:\d+\s*[.)]|[-*•])\s+")


def _lines(text: str) -> Iterator[tuple[list[str], bool, bool]]:
    """(tokens, whether it is a list item, whether it is the last) for each line."""
    lines = text.split("\n")
    for i, line in enumerate(lines):
        m = _ITEM.match(line)
        yield tokens(line[m.end() :] if m else line), bool(m), i == len(lines) - 1


def _keys(run: list[str], item: bool) -> list[str]:
    """Contexts at the end of run, the longest first. In list items the head of a line is kept apart from its tail."""
    top = min(ORDER, len(run))
    if not item:
        return [" ".join(run[-n:]) for n in range(top, 0, -1)]
    return [("• " if n == len(run) else "· ") + " ".join(run[-n:]) for n in range(top, 0, -1)]


def context_counts(texts: list[str], last_words: set[str] | None = None) -> Counter:
    """(context, ends): contexts of 1 to ORDER words, counted by whether the sentence or line ends after them.

    Only contexts that end in one of last_words are counted if these are given.
    """
    counts: Counter = Counter()
    for text in texts:
        for toks, item, last in _lines(text):
            run: list[str] = []
            for i, t in enumerate(toks):
                if t in _END:
                    run = []
                    continue
                run.append(t)
                more = i + 1 < len(toks)
                if not more and last:
                    continue  # whether the text is whole at its very end is the question
                if last_words is not None and t not in last_words:
                    continue
                ends = not more or toks[i + 1] in _END
                for k in _keys(run, item):
                    counts[k, ends] += 1
    return counts


def final_contexts(response: str) -> list[str]:
    """Contexts at the end of a response without a final stop, the longest first; [] if it has one or is short."""
    t = visible(response).rstrip(_CLOSERS)
    if not t or t[-1] in _END or ("\n" not in t and len(t.split()) <= SHORT and not _CJK.search(t)):
        return []
    *above, (toks, item, _) = list(_lines(t))
    run: list[str] = []
    for w in toks:
        run = [] if w in _END else [*run, w]
    # items of one list often end alike: an ending of an item above is one here too, but not as the head of an item
    ends = {tuple(ts[-2:]) for ts, is_item, _ in above if is_item and len(ts) > 3}
    if item and len(run) > 3 and tuple(run[-2:]) in ends:
        return []
    return _keys(run, item)


def label_row(prompt: str | None, response: str | None, learned: dict[str, str] | None = None) -> tuple[str | None, list[str]]:
    """The label that needs no corpus, and the contexts that decide on 'truncated' where there is none yet."""
    if is_empty(response):
        return "empty", []
    if copies_prompt(prompt, response):
        return "copies_prompt", []
    if is_refusal(response):
        return "refusal", []
    cut = broken_json(response)
    if cut is not None:
        return ("truncated" if cut else None), []
    lang = "wrong_language" if wrong_language(prompt, response, learned) else None
    return lang, final_contexts(response)


def defective_pairs(pairs: DataFrame, least_share: float = 0.5, most_asked: int = 500_000) -> DataFrame:
    """(pair_id, defect): one row for each defective pair.

    The last words of open-ended responses, if they are at most most_asked, are sent to
    the count of contexts, which then leaves out all others before the shuffle; the result
    is the same without.
    """
    rows = spread(pairs.select("pair_id", "prompt", "response"))
    learned = learned_words(rows)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [label_row(p, r, learned) for p, r in zip(b["prompt"], b["response"])]
            out = pd.DataFrame({"pair_id": b["pair_id"], "defect": [g[0] for g in got], "contexts": [g[1] for g in got]})
            yield out[out["defect"].notna() | (out["contexts"].str.len() > 0)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both: dict[str, list[int]] = {}
            for (c, ends), n in context_counts([t for col in ("prompt", "response") for t in b[col] if t], last_words).items():
                both.setdefault(c, [0, 0])[ends] += n
            if both:
                yield pd.DataFrame({"context": list(both), "goes_on": [v[0] for v in both.values()], "ends": [v[1] for v in both.values()]})

    id_type = pairs.schema["pair_id"].dataType.simpleString()
    labelled = rows.mapInPandas(label, f"pair_id {id_type}, defect string, contexts array<string>").persist()
    open_ended = labelled.filter("size(contexts) > 0").select("pair_id", F.posexplode("contexts").alias("pos", "context"))
    fits, asked = bounded(open_ended.select(F.substring_index("context", " ", -1).alias("w")).distinct(), most_asked)
    last_words = {r.w for r in asked} if fits else None
    counted = rows.mapInPandas(count, "context string, goes_on bigint, ends bigint").join(
        open_ended.select("context").distinct(), "context", "left_semi"
    ).groupBy("context").agg(F.sum("goes_on").alias("goes_on"), F.sum("ends").alias("ends"))
    # the longest context that the corpus knows decides; a last word it doesn't know is a broken one
    known = open_ended.join(counted, "context", "left").withColumn("n", F.coalesce(F.col("goes_on") + F.col("ends"), F.lit(0)))
    verdict = known.groupBy("pair_id").agg(
        F.min(F.when(F.col("n") > 0, F.struct("pos", (F.col("ends") / F.col("n")).alias("share")))).alias("best")
    ).select("pair_id", (F.coalesce(F.col("best.share"), F.lit(0.0)) < least_share).alias("cut"))
    return (
        labelled.join(verdict, "pair_id", "left")
        .select("pair_id", F.when(F.coalesce("cut", F.lit(False)), "truncated").otherwise(F.col("defect")).alias("defect"))
        .filter("defect IS NOT NULL")
        .distinct()
    )
