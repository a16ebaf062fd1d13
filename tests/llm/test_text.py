"""Residue, pairs, spam, scanned pages: cases, traps and defined results."""

import itertools

import numpy as np
import pytest

from marlstone.llm import pairs, residue, scan_repair, spam

PROSE = "The library opens at nine and the tutors answer questions about the course. A learner may carry at most nine credits per term. Results appear on the day after the exam, and each office keeps its own list of names. "


@pytest.mark.parametrize(
    "text",
    [
        "Dear {{ student_name }}, welcome.", "The fee is ${amount} now", "see [INSERT COURSE NAME] here", "(enter deadline here) is due", "value [object Object]", "on XX/XX/XXXX", "<office goes here>", "<<term>>", "@@year@@ x", "__LEVEL__ x", "%YEAR% x", "#{mentor} x", "$level$ x", "[[deadline]]",
        "HTTP 500 Internal Server Error", "Please enable\nJavaScript to view", "Seite nicht ge-\nfunden, Fehler 404", "Cette page est introuvable", "la página solicitada no existe", "Lorem ipsum dolor sit amet", "Nulla pariatur excepteur sint occaecat cupidatat non proident", "asdf test foo qwerty blah xxx test", "Your text goes here.",
    ],
)
def test_residue_cases(text):
    coverage, kinds = residue.scan(PROSE + text)
    assert 0 < coverage <= 1 and kinds


@pytest.mark.parametrize(
    "text",
    [
        None, "", "   ", "If the tool shows error 404 or a blank page, write to us.", "The course uses JavaScript, so bring a laptop.", "The server answers with status 503.", "print total[i] for each i", "the set {1, 2, 40}", "[121] see [link](https://a.example)", "An access denied message usually means the fee is open.",
        "Typesetters use dummy text to judge a page.", "The template has a field marked name.", "50% of 100% of it", "a_b__c d__e", "test the foo", "costs $5 and $6", PROSE,
    ],
)
def test_residue_traps(text):
    assert residue.scan(text) is None


@pytest.mark.parametrize(
    "text",
    [
        "When the browser shows 404 not found the file has been moved.", "The help page explains what page not found means and how to report it.", "He wrote 'internal server error' on the form.",
        "Students who read that a bad gateway is a fault of the network are right.",
    ],
)
def test_texts_about_messages_are_no_residue(text):
    assert residue.scan(text) is None and residue.scan(PROSE + text) is None


@pytest.mark.parametrize("text", ["Sorry, page not found. Go back.", "HTTP 500 internal server error, try again", PROSE + " 502 Bad Gateway returned by the proxy.", "# Notes\nplease enable\njavascript to go on"])
def test_messages_of_their_own_are_residue(text):
    assert residue.scan(text)


@pytest.mark.parametrize(
    "field",
    [
        "{{ name }}", "${name}", "#{name}", "<% name %>", "{% if name %}", "[[ name ]]", "@@NAME@@", "__NAME__", "%NAME%", "$NAME$", "<<NAME>>", "<name here>", "<name goes here>", "[INSERT NAME]", "[ENTER NAME]", "[ADD COURSE NAME]",
        "[YOUR NAME]", "[COURSE NAME HERE]", "(enter a date here)", "(insert a date here)", "(add a date here)", "[object Object]", "XX/XX/XXXX",
    ],
)
def test_every_field_calls_the_grammar(field):
    assert residue.scan(field)[1] == ["template_field"]


def test_residue_table(spark):
    rows = [("a", "{{ x }}", "k", 1), ("a", "{{ x }}", "k", 2), (None, "{{ x }}", "k", 1), ("b", None, "k", 1), ("c", "", "k", 1), ("d", PROSE * 2000 + "Bad Gateway", "k", 1), ("e", PROSE, "k", 1)]
    df = spark.createDataFrame(rows, "id string, text string, k string, t int")
    got = residue.find_residue(df, "id", "text").collect()
    assert sorted(r["id"] for r in got) == ["a", "d"] and next(r for r in got if r["id"] == "a")["kinds"] == ["template_field"]
    assert residue.find_residue(df, "id", "text", 0.5).count() == 1
    assert residue.find_residue(df.where("1 = 0"), "id", "text").count() == 0
    assert residue.without_residue(df, "id", "text", 0.0).count() == 4
    kept = [r["id"] for r in residue.without_residue(df, "id", "text").collect()]
    assert len(kept) == 5 and "d" in kept  # a long page that holds one message stays


Q = ["When does the lab viva in Tidal Optics take place?", "How many credits does it carry?"]


@pytest.mark.parametrize(
    "text, want",
    [
        (None, "empty"), ("", "empty"), ("# Head\n\n​ —", "empty"), ("# Head\nAnswer:", "empty"), ("# H\n\nA:", "empty"),
        ("# H\n\nYou asked: " + Q[0], "copied"), ("# H\n\nWHEN DOES THE LAB VIVA IN TIDAL OPTICS TAKE PLACE?", "copied"), ("# H\nQ: " + Q[0] + "\nA: " + Q[0], "copied"), ("# H\n\n" + " ".join(Q), "copied"),
        ("# H\n\nI'm sorry, but I can't help with questions about the exam.", "refusal"), ("# H\n\nEs tut mir leid, dazu kann ich keine Auskunft geben.", "refusal"), ("# H\n\nLo siento, no puedo responder a esa pregunta.", "refusal"),
        ("# H\n\n" + PROSE + "The hall for the viva opens at", "truncated"), ("# H\n\n" + PROSE + "The hall for the vi...", "truncated"), ("# H\n\n" + PROSE + "It opens (", "truncated"),
        ("# H\n\nDie Prüfung ist am Montag und die Noten werden mit der Post an alle geschickt. Wer krank ist, legt ein Attest vor.", "other_language"),
        ("# H\n\n" + PROSE, None), ("# H\n\n" + Q[0] + " " + PROSE, None), ("# H\n\n" + PROSE + "\n\n- Tidal Optics\n- Polar Signals", None), ("# H\n\n" + PROSE + '("It is so.")', None),
        ("# H\n\n" + PROSE + " I do not know my number is no excuse at the door, says the notice. " + PROSE, None),
    ],
)
def test_pair_defects(text, want):
    assert pairs.defect(Q, text) == want


def test_copies_of_any_length_and_kind():
    again = "# H\n\n" + " ".join([Q[0]] * 200)
    assert pairs.defect(Q[:1], "# H\n\n" + " ".join([Q[0]] * 5)) == "copied" and pairs.defect(Q, again) == "copied"
    assert pairs.defect(Q, "# H\n\n" + Q[0], "table") == "copied" and pairs.defect(Q, again, "table") == "copied"
    assert pairs.defect(Q, "# H\n\n" + Q[0] + " " + PROSE * 3) is None and pairs.defect(Q, "A | B\nA: 1, B: Exam", "table") is None


POLITE = "Thank you very much for your question about the viva and the credits of this course, which is of great importance to many learners who have written to this office during the last weeks. "
WHY = "Rules differ from year to year and the office alone keeps the list. " * 8


@pytest.mark.parametrize(
    "text, want",
    [
        (POLITE + "Unfortunately, I cannot answer it.", "refusal"), ("I'm sorry, but I can't help with the exam. " + WHY, "refusal"), (POLITE * 3 + "Unfortunately,\nI cannot answer it. " + WHY, "refusal"), (POLITE * 3 + "I am un-\nable to say.", "refusal"),
        ("As an AI, I do not discuss fees. " + WHY, "refusal"), ("Es tut mir leid, dazu kann ich keine Auskunft geben. " + WHY, "refusal"), ("Rules differ. I cannot answer this. " + WHY, "refusal"),
        (PROSE * 2 + "If I am unable to come, the tutor gives a new date. " + WHY, None), ("The sheet serves as an aid to learners and I keep it. " + WHY, None), ("She works as an assistant in the lab. " + WHY, None),
        ('Whoever says "I cannot answer this" loses no marks. ' + WHY, None), (PROSE * 8 + "I cannot answer more.", None),
    ],
)
def test_refusals_in_the_whole_response(text, want):
    assert pairs.defect(Q, "# H\n\n" + text) == want


def test_suffix_automaton_finds_all_stretches():
    rng = np.random.default_rng(3)
    for _ in range(200):
        p = [[str(x) for x in rng.integers(0, 4, rng.integers(1, 12))] for _ in range(2)]
        r = [str(x) for x in rng.integers(0, 5, rng.integers(1, 20))]
        grams = {tuple(q[i : i + pairs.COPY_RUN]) for q in p for i in range(len(q) - pairs.COPY_RUN + 1)}
        hit = np.zeros(len(r), bool)
        for i in range(len(r) - pairs.COPY_RUN + 1):
            if tuple(r[i : i + pairs.COPY_RUN]) in grams:
                hit[i : i + pairs.COPY_RUN] = True
        assert abs(pairs.copied_share(p, r) - hit.mean()) < 1e-9


def test_pair_table(spark):
    rows = [("a", [Q[0], " "], "# H\n\n-", "text", "x"), ("a", [Q[0], " "], "# H\n\n-", "text", "y"), ("b", None, "# H\n\n-", "text", "x"), ("c", [" ", None], "# H", "text", "x"), ("d", [Q[0]], None, "text", "x"), (None, [Q[0]], "", "text", "x"), ("e", [Q[0]], "A | B\nA: 1, B: Exam", "table", "x")]
    df = spark.createDataFrame(rows, "id string, qs array<string>, body string, kind string, k string")
    assert {(r["id"], r["defect"]) for r in pairs.find_defects(df, "id", "qs", "body", "kind").collect()} == {("a", "empty"), ("d", "empty")}
    assert pairs.find_defects(df.where("1 = 0"), "id", "qs", "body", "kind").count() == 0


SENTENCES = [
    "The library of {n} opens at nine and closes when the last reader has left.", "Whoever is late may ask the office in {n} for a second date.", "Results appear on the board after the marks have been read by two tutors.",
    "A learner from {n} may carry at most nine credits per term.", "Each report is kept for a year and then moved to the archive.", "If the file is too large, the mentor opens a ticket and sends it by post.",
    "Before the exam, the hall is read twice and the names are checked at the door.", "An appeal costs five crowns, which are returned when the mark changes.", "The reading list names ten titles, of which four are required in {n}.",
    "Groups of three share one diary and hand it in with the report.", "No course starts with fewer than six learners, unless the board of {n} decides so.", "Those with few credits meet their tutor once per term.",
    "After the oral exam, scripts are shown to the learners for one week.", "Field trips to {n} are part of the course and cost a small fee.", "Questions about the fee belong on the board, where they are answered by the office.",
]


def corpus():
    rng = np.random.default_rng(1)
    names = [f"Name{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(5)]
    return [(i, " ".join(SENTENCES[j].format(n=rng.choice(names)) for j in rng.permutation(len(SENTENCES))[:10])) for i in range(80)]


def test_spam(spark):
    links = "\n".join(f"[cheap course {i % 9} notes](https://x.example/{i})" for i in range(60))
    words = ", ".join(["online optics degree", "cheap exam notes", "optics course"] * 30)
    echo = "Looking for optics? Our optics is optics. Best optics for optics. Why optics? Because optics means optics. " * 8
    menu = "Home | More | Next | Fees | Exams | Home | Contact | Next | " * 12
    listed = "\n".join(f"* [Page {i}](https://x.example/{i}): {s.format(n='Optics')}" for i, s in enumerate(SENTENCES))
    extra = [(100, links), (101, words), (102, "# optics\n\nThe office sends the list to each learner.\n\n" + words), (103, echo), (104, menu), (105, listed), (106, None), (107, ""), (108, "cheap notes cheap notes"), (109, " \n "), (101, words)]
    df = spark.createDataFrame([(k, t, "x") for k, t in corpus() + extra], "id int, text string, k string")
    assert {r["id"] for r in spam.find_spam(df, "id", "text").collect()} == {100, 101, 102, 103, 104}
    assert spam.find_spam(df.where("1 = 0"), "id", "text").count() == 0


def page(header, number, body):
    return "\n".join([header, *body, number])


def test_scanned_pages(spark):
    sentence = ["The mentor reads the report and sends the marks to", "the office before the final exam begins. Learners with", "a long absence may ask the office for a second date.", "Results appear on the board after the report is read."]
    pages = [(f"p{i}", page(f"Guide of Optics | Chapter {i}", f"- {i} -", sentence)) for i in range(30)]
    broken = ["The mentor reads the rep-", "ort and sends the marks to the offlce before the", "final exam begins. Learners with a l0ng absence", "may ask the office for a second date. A mid-", "term report is read, and every mid-term report counts."]
    pages += [("x", page("Guide of Optics | Chapter 99", "[12]", broken)), ("x", page("Guide of Optics | Chapter 99", "[12]", broken)), ("n", None), ("e", ""), ("s", "one line only"), (None, "a\nb")]
    df = spark.createDataFrame([(k, t, 1) for k, t in pages], "f string, c string, k int")
    got = {(r["line_no"], r["noise_kind"]) for r in scan_repair.find_noise(df, "f", "c").where("f = 'x'").collect()}
    assert got == {(1, "header"), (7, "page_no"), (2, "hyphen"), (3, "misread"), (4, "misread")}
    every = {(r["f"], r["noise_kind"]) for r in scan_repair.find_noise(df, "f", "c").where("f <> 'x'").collect()}
    assert every == {(f"p{i}", k) for i in range(30) for k in ("header", "page_no")}
    text = {r["f"]: r["text"] for r in scan_repair.repair(df, "f", "c").collect()}
    assert text["x"] == "The mentor reads the report and sends the marks to the office before the final exam begins. Learners with a long absence may ask the office for a second date. A mid-term report is read, and every mid-term report counts."
    assert text["s"] == "one line only" and "n" not in text and "e" not in text
    assert scan_repair.find_noise(df.where("1 = 0"), "f", "c").count() == 0


def test_corrections():
    assert ("crowns", 0) in scan_repair.corrections("(rowns") and ("until", 2) in scan_repair.corrections("un†il") and ("office", 1) in scan_repair.corrections("oﬃce")
    assert scan_repair.core("HN-31329") is None and scan_repair.core("12,500") is None and scan_repair.core("(most") == "(most" and scan_repair.core("“word”,") == "word"


def test_answers_in_a_close_language_and_of_few_votes():
    fr = "Titre\nLes frais pour Statistique s'élèvent à 1450 couronnes, payables en deux fois. Le stage de Géométrie a lieu à Pellmark et dure 24 jours."
    assert pairs.defect(["What share of the mark comes from the end-term exam?"], fr) == "other_language"
    assert pairs.defect(["¿Cuántos créditos tiene el curso Navegación costera?"], fr) == "other_language"
    assert pairs.defect(["Combien coûte l'examen de Statistique ?"], fr) is None


def test_text_and_type_come_from_one_row(spark):
    rows = [("a", ["When is the exam?"], "T\nThe exam is in May and the", "text"), ("a", ["When is the exam?"], "U\nThe exam is in May.", "table")]
    df = spark.createDataFrame(rows, "id string, q array<string>, t string, c string")
    assert [r["defect"] for r in pairs.find_defects(df, "id", "q", "t", "c").collect()] == ["truncated"]


def test_spam_on_both_sides_of_the_prose(spark):
    bare = "\n".join(f"https://x.example/{i % 50}" for i in range(200))
    tags = " ".join(f"cheap {w} notes online {w} degree" for w in ("optics", "logic", "harbour", "music", "botany") * 12)
    reading = " ".join(s.format(n="Optics") for s in SENTENCES) + "\n\n" + "\n".join(f"* https://x.example/{i}" for i in range(4))
    listed = "\n\n" + "\n".join(f"https://x.example/{i}" for i in range(12))  # prose that knows lists of addresses
    df = spark.createDataFrame([*((i, t + listed) for i, t in corpus()), (200, bare), (201, tags), (202, reading)], "id int, text string")
    scores = {r["id"]: r for r in spam.score_pages(df, "id", "text").collect()}
    assert {k for k, r in scores.items() if r["abnormal"] >= spam.SHARE} == {200, 201}
    assert scores[200]["prose_perplexity"] < scores[202]["prose_perplexity"] < scores[201]["prose_perplexity"]


def test_spread_of_scores():
    counts = np.zeros(spam.BINS * spam.TOP, int)
    draws = np.random.default_rng(3).normal(5.0, 0.6, 200_000)
    np.add.at(counts, (draws * spam.BINS).astype(int), 1)
    median, spread = spam.usual(counts)
    assert abs(median - 5.0) < 0.02 and abs(spread - 0.6) < 0.02


def test_word_filter_holds_its_words_and_few_others(spark):
    words = [f"wörd{i}" for i in range(500)]
    table = scan_repair.word_filter(spark.createDataFrame([(w,) for w in words], "word string"))
    bits = len(table) << 5
    held = lambda w: all(table[p >> 5] >> (p & 31) & 1 for p in scan_repair.filter_bits(w, bits))
    assert all(map(held, words)) and sum(held(f"other{i}") for i in range(2000)) < 100
    assert not scan_repair.word_filter(spark.createDataFrame([], "word string")).any()


def test_pages_are_labelled_together_as_one_by_one():
    rng = np.random.default_rng(5)
    pages = [np.stack([rng.integers(0, n, k) for n in scan_repair.SIZES], axis=1) for k in (1, 7, 3, 12, 7, 1)]
    sizes = np.array([len(p) for p in pages])
    both = np.concatenate(pages)
    counts = np.zeros((scan_repair.STATES, 1 + scan_repair.STATES + scan_repair.WIDTH))
    scan_repair.tally(both, sizes, scan_repair.viterbi(both, sizes, None), counts)
    assert counts[:, 0].sum() == len(pages) and counts[:, 1 : scan_repair.STATES + 1].sum() == sizes.sum() - len(pages)
    model = scan_repair.estimate(counts)
    alone = np.concatenate([scan_repair.viterbi(p, np.array([len(p)]), model) for p in pages])
    assert (scan_repair.viterbi(both, sizes, model) == alone).all()
    assert len(scan_repair.viterbi(both[:0], sizes[:0], model)) == 0


def best_path(x, model):
    """Every labelling of a short page, by its score."""
    n, s = len(x), scan_repair.STATES
    emit = lambda y, i: sum(model[y, s + 1 + scan_repair.OFFSETS[f] + x[i, f]] for f in range(len(scan_repair.SIZES)))
    score = lambda ys: model[ys[0], 0] + sum(model[a, 1 + b] for a, b in itertools.pairwise(ys)) + sum(emit(y, i) for i, y in enumerate(ys))
    return max(itertools.product(range(s - 1), repeat=n), key=score)


def test_viterbi_finds_the_best_labelling():
    rng = np.random.default_rng(8)
    model = scan_repair.estimate(rng.integers(1, 50, (scan_repair.STATES, 1 + scan_repair.STATES + scan_repair.WIDTH)).astype(float))
    for _ in range(5):
        x = np.stack([rng.integers(0, n, 4) for n in scan_repair.SIZES], axis=1)
        x[:, 0], x[:, 11], x[:, 12] = x[:, 0] % 5, 0, 0  # no blank lines, no tables: no label is ruled out
        assert tuple(scan_repair.viterbi(x, np.array([4]), model)) == best_path(x, model)
