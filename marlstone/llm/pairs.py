"""Defects of prompt-response pairs (problem 6).

A pair is a record with at least one non-blank prompt; the response is its text without the heading line.
Each defective pair gets exactly one defect, tested in this order:

* ``empty``: nothing is left after labels such as "Answer:", punctuation and invisible characters.
* ``copied``: the words of the response are traversed through the *suffix automaton* of the prompts; stretches of
  at least COPY_RUN words that occur in a prompt count as copied; defective when they make up COPY_SHARE of
  the words, labels such as "You asked" aside, however long the response and in text and table chunks alike.
* ``refusal``: an Aho-Corasick automaton of refusals in four languages runs over the whole response.  Any match
  counts in a response of at most REFUSAL_WORDS words.  A longer one refuses if no more words precede the matched
  sentence, courtesies and sentences in the first person aside, than follow from it on; there a match that is
  quoted or conditional ("if I am unable to") does not count, nor a role ("as an assistant") without a first person.
* ``other_language``: stopword votes of the prompts name a language, and in the response another one has VOTES votes
  or more and at least VOTE_MARGIN times those of the prompts' language.
* ``truncated``: the last sentence has no end.  A stack of delimiters tells closing marks from open ones: an open
  bracket or a dash at the end, an ellipsis, or a missing full stop outside lists, tables and menus.

Defined cases: records with null or only blank prompts or a null key give no row; a null or empty text counts
as an empty response; repeated rows of one key count once with all their prompts; ties in the votes
name no language; an empty table gives no rows; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .residue import JOIN, normalise

COPY_RUN, COPY_SHARE, REFUSAL_WORDS = 3, 0.8, 60
VOTES, VOTE_MARGIN = 3, 2.0

REFUSALS = (
    "i can't help with", "i cannot help with", "i can't assist", "i cannot assist", "i'm unable to", "i am unable to", "i'm not able to", "i am not able to", "i cannot provide", "i can't provide",
    "i cannot answer", "i can't answer", "it isn't possible for me to", "it is not possible for me to", "as a language model", "as an ai", "as an assistant", "i must decline", "i have to decline", "i won't be able to",
    "would go against my guidelines", "against my guidelines", "falls outside of what i can do", "outside of what i can do for you", "i do not have enough information to answer", "i don't have enough information",
    "the context does not say", "i don't know the answer", "i do not know the answer", "i would rather not comment", "i'd rather not", "no answer can be given", "unable to discuss", "i cannot discuss",
    "i'm sorry, but i can", "i am sorry, but i can", "unfortunately, i cannot", "unfortunately, i can't",
    "dazu kann ich keine auskunft geben", "als sprachmodell", "als assistent", "leider kann ich", "ich kann diese frage nicht beantworten", "kann ich nicht beantworten", "nicht genugend informationen", "ich kann dazu nichts sagen", "ich darf dazu", "es tut mir leid, dazu", "es tut mir leid, aber ich", "mir fehlen informationen",
    "je ne peux pas repondre", "je ne suis pas en mesure", "en tant qu'assistant", "en tant que modele", "il m'est impossible de", "je n'ai pas assez d'informations", "je ne dispose pas", "je suis desole, je ne", "je prefere ne pas", "je regrette, mais je ne",
    "no puedo responder", "no puedo ayudar", "como asistente no", "como modelo de lenguaje", "como asistente", "no dispongo de informacion suficiente", "no tengo suficiente informacion", "no me esta permitido", "lo siento, no puedo", "lamento no poder", "no estoy en condiciones de",
)
LABELS = re.compile(r"^(?:a|q|r|ans|answer|antwort|reponse|respuesta|response|question|frage|pregunta|you asked|the question is|die frage lautet|la question est|la pregunta es|n/a|none|null|nan|tbd|todo|no answer|keine antwort|pas de reponse|sin respuesta)(?=[\s:.\-–—]|$)[\s:.\-–—]*", re.I)
STOPWORDS = {
    "en": "the of and to in is that for it with as on at by this from or an be are was which not have has when who before after where how what can may until under each does only their one its per".split(),
    "de": "viel viele welche welcher welches wo warum der die das und ist nicht ein eine einen den dem des mit für von zu auf wird werden im am bei nach vor wie wer wann bis muss man sind sich auch oder wenn durch aus zur zum nur haben kann über unter sofern".split(),
    "fr": "combien quel quelle quels quelles pourquoi où le la les des et est une du pour dans que qui sur par au aux avec il elle ce cette ces pas ne plus après avant quand combien faut se sont ou comment doit peut entre leur sans jusqu être sa".split(),
    "es": "cuántos cuántas cuánta cuál cuáles dónde el la los las y es una del para en que se por con al un no su más después antes cuándo cuánto hay quién puede son o como lo sin hasta desde debe cada sus este esta sobre cómo qué está".split(),
}
_VOTE = {w: [lang for lang, ws in STOPWORDS.items() if w in ws] for ws in STOPWORDS.values() for w in ws}
#: Matches that name a role; in long responses they need a first person after them.
ROLES = re.compile(r"(?:as an? (?:language model|ai|assistant)|als (?:sprachmodell|assistent)|en tant qu(?:'assistant|e modele)|como (?:asistente|modelo de lenguaje))$")
FIRST_PERSON = re.compile(r"\b(?:i|me|my|ich|mir|je|j|yo|puedo|debo|tengo|estoy|lamento)\b")
COURTESY = re.compile(r"\b(?:thanks?|sorry|glad|appreciate|apolog\w+|please|hello|hi|dear|welcome|dank\w*|bitte|hallo|liebe[rs]?|leider|entschuldig\w+|merci|bonjour|desole\w*|cher|chere|gracias|hola|estimad[oa]s?|siento|disculp\w+)\b")
REPORTED = re.compile(r"(?:\S\s+[\"'“„«‘]|\b(?:if|when|whether|wenn|falls|si|quand|lorsque|cuando)\s)\s*$")
SENTENCE = re.compile(r"\n|(?<=[.!?:])[\"'”»)]*\s")
WORD = re.compile(r"[^\W_]+")
INVISIBLE = re.compile("[​-‏⁠﻿­]")
ITEM = re.compile(r"^\s*(?:[-*•–]|\(?\d{1,3}[.)]|[a-z][.)])\s+")
MENU = re.compile(r"(?:\S\s+[|/·>»•]\s+\S.*){2,}")
OPENERS = {"(": ")", "[": "]", "{": "}", "„": "“", "«": "»", "“": "”"}


def automaton_of(words: list[list[str]]) -> tuple[list[dict[str, int]], list[int], list[int]]:
    """Suffix automaton over the words of several prompts (transitions, links, lengths)."""
    nxt: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    for prompt in words:
        last = 0
        for w in prompt:
            if w in nxt[last] and length[nxt[last][w]] == length[last] + 1:
                last = nxt[last][w]  # this prefix is there already
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(w) == q:
                        nxt[p][w] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
    return nxt, link, length


def copied_share(prompts: list[list[str]], response: list[str]) -> float:
    """Part of the response's words that lie in stretches of at least COPY_RUN words of a prompt."""
    if not response:
        return 0.0
    nxt, link, length = automaton_of(prompts)
    state = size = 0
    covered_to = covered = 0
    for i, w in enumerate(response, 1):
        while state and w not in nxt[state]:
            state = link[state]
            size = length[state]
        if w in nxt[state]:
            state, size = nxt[state][w], size + 1
        if size >= COPY_RUN:
            covered += i - max(covered_to, i - size)
            covered_to = i
    return covered / len(response)


@cache
def refusal_automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p in REFUSALS:
        q = normalise(p)
        a.add_word(q, len(q))
    a.make_automaton()
    return a


def refuses(core: str, plain: str, n_words: int) -> bool:
    """Whether the response, normalised to plain, declines to answer."""
    lines = ""
    for last, size in refusal_automaton().iter(plain):
        if n_words <= REFUSAL_WORDS:
            return True
        start, end = last + 1 - size, last + 1
        if not lines:  # the same places as in plain, with the line breaks
            lines = "\n".join(filter(None, map(normalise, JOIN.sub("", core).split("\n"))))
            lines = lines if len(lines) == len(plain) else plain
        if start and plain[start - 1].isalnum() or REPORTED.search(plain, max(start - 20, 0), start):
            continue
        if ROLES.search(plain, start, end):
            stop = SENTENCE.search(lines, end)
            if plain.endswith("as an ai", start, end) and plain[end : end + 1].isalnum() or not FIRST_PERSON.search(plain, end, stop.start() if stop else len(plain)):
                continue
        *before, lead = SENTENCE.split(lines[:start])
        answering = sum(len(WORD.findall(x)) for x in before if not FIRST_PERSON.search(x) and not COURTESY.search(x))
        return answering <= len(WORD.findall(lead)) + len(WORD.findall(plain, start))  # later matches leave even less
    return False


def votes(words: list[str]) -> dict[str, float]:
    """Stopword votes of the languages; a word of several languages is shared among them."""
    out = dict.fromkeys(STOPWORDS, 0.0)
    for w in words:
        for lang in (langs := _VOTE.get(w, ())):
            out[lang] += 1 / len(langs)
    return out


def other_language(prompts: list[str], response: list[str]) -> bool:
    """Whether the words of the response are of another language than those of the prompts."""
    asked = votes(prompts)
    (lang, most), (_, second) = sorted(asked.items(), key=lambda x: -x[1])[:2]
    if most < 1 or most < VOTE_MARGIN * second:
        return False
    own = votes(response)
    return max(own.values()) >= max(VOTES, VOTE_MARGIN * own[lang])


def breaks_off(response: str) -> bool:
    """Whether the response ends within a sentence."""
    lines = [x for x in response.split("\n") if x.strip()]
    if not lines:
        return False
    last = lines[-1].strip()
    if re.search(r"\.\.\.$|…$", last):
        return True
    open_marks: list[str] = []
    for c in last:  # what the last line opens and does not close
        if c in OPENERS:
            open_marks.append(OPENERS[c])
        elif open_marks and c == open_marks[-1]:
            open_marks.pop()
    bare = last.rstrip("\"'”“»)]}*_`’ ")
    if not bare or bare[-1] in ".!?:;。":
        return False
    if bare[-1] in "([{„«,–—-" or open_marks:
        return True
    if re.search(r"https?://\S+$", last) or len(last.split()[-1]) > 40:
        return False  # an address or a block of data
    if "|" in last or re.search(r"(?:^|, )[A-Z]\w+: [^,]+, [A-Z]\w+: ", last) or MENU.search(last):
        return False  # a table row or a menu
    if ITEM.match(last):
        others = [x.strip() for x in lines[:-1] if ITEM.match(x)]
        return len(others) >= 1 and sum(x.rstrip("\"'”“»)]*_ ")[-1:] in ".!?" for x in others) > len(others) / 2
    return bool(re.search(r"[.!?](?:\s|$)", response)) or len(bare.split()) >= 6


def defect(prompts: list[str], text: str | None, kind: str = "text") -> str | None:
    """The defect of one pair; None for a sound pair."""
    if text is None:
        return "empty"
    head, _, response = text.partition("\n")
    response = INVISIBLE.sub("", response)
    core = response.strip()
    plain = normalise(core)
    bare = plain.strip(" .-–—:;,…*_#>|\"'")
    while (m := LABELS.match(bare)) and m.end():
        bare = bare[m.end() :].strip(" .-–—:;,…*_#>|\"'")
    if not WORD.search(bare):
        return "empty"
    table_like = kind == "table"
    own = WORD.findall(core.lower())
    asked = [WORD.findall(q.lower()) for q in prompts]
    parts = []
    for piece in re.split(r"\n|(?<=[?:])\s", core):  # labels are no words of the answer
        p = piece.strip()
        while (m := LABELS.match(normalise(p))) and m.end() and p:
            p = p[m.end() :].strip()
        parts += WORD.findall(p.lower())
    if parts and copied_share(asked, parts) >= COPY_SHARE:
        return "copied"
    if refuses(core, plain, len(own)):
        return "refusal"
    if other_language([w for q in asked for w in q], own):
        return "other_language"
    if not table_like and breaks_off(core):
        return "truncated"
    return None


def find_defects(df: DataFrame, key: str, prompts: str, text: str, kind: str) -> DataFrame:
    """(key, defect STRING) of every defective pair; see the module for the defined cases."""
    real = F.filter(prompts, lambda q: F.regexp_replace(q, r"[\s\p{Z}\p{Cf}]", "") != "")
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), real.alias("q"), F.col(text).alias("t"), F.col(kind).alias("c"))
    # text and type come from one row, that of the least text
    rows = rows.where(F.size("q") > 0).groupBy("k").agg(F.min(F.struct(F.isnull("t").alias("n"), "t", "c")).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("q")))).alias("q")).select("k", "r.t", "r.c", "q")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(k, d) for k, q, t, c in zip(pdf["k"], pdf["q"], pdf["t"], pdf["c"]) if (d := defect(list(q), t, c))]
            yield pd.DataFrame(found, columns=["k", "defect"])

    return rows.mapInPandas(run, f"k {df.schema[key].dataType.simpleString()}, defect string").withColumnRenamed("k", key)
