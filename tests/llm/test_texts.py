import random

import numpy as np
import pytest

from strandloom.llm import languages, leakage

NAMES = ["Zarumel", "Brinkast", "Tolvenor", "Quistane"]
WORDS = [a + b for a in ("bal", "cor", "den", "fos", "gim", "hur", "jat", "kel") for b in ("ta", "re", "mi", "no", "su", "pe", "la", "vi")]


def items_of(n):
    rng = random.Random(1)
    return [(i, " ".join(rng.choice(WORDS) for _ in range(18)) + f" in {rng.choice(NAMES)} with {rng.randrange(10, 999)} km of " + " ".join(rng.choice(WORDS) for _ in range(18)) + ". Which answer is right?") for i in range(n)]


ITEMS = items_of(30)


def found(spark, texts, items=ITEMS):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, h string, at int")
    q = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, words string")
    return {(r["doc_id"], r["item_id"]): r for r in leakage.leaks(d, q).collect()}


def verbatim(spark, texts, items=ITEMS):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, q).filter(leakage.verbatim()).collect()}


def test_passages_under_markup_case_notes_and_changes(spark):
    rng = random.Random(5)
    noise = lambda n: " ".join("zq" + rng.choice(WORDS) for _ in range(n))
    w = ITEMS[3][1].split()
    marked = " ".join(f"\\emph{{{x}}}" if i % 5 == 2 else x + ("~" if i % 7 else "\\,") for i, x in enumerate(w[4:34]))
    noted = " ".join(x + ("\\footnote{See text.}" if i % 6 == 3 else "") for i, x in enumerate(w))
    changed = " ".join("quite" if i % 11 == 5 else x for i, x in enumerate(w[:35]) if i % 13 != 12)
    texts = [
        noise(50) + " " + marked + noise(50), "% " + ITEMS[3][1].upper().replace(" ", "\n% "), noise(9) + noted, noise(30) + " " + changed + " " + noise(30),
        " ".join(w[2:12]) + " " + noise(40), noise(100), None, "", "Which answer is right? " * 30, ITEMS[4][1] + noise(3) + ITEMS[5][1],
    ]
    assert verbatim(spark, texts) == {(0, 3), (1, 3), (2, 3), (3, 3), (9, 4), (9, 5)}


def test_refilled_templates_are_reported_but_not_verbatim(spark):
    item = ["one " + " of ".join(f"{a} Zarumel {n} {b}" for a, n, b in zip(WORDS[:12], range(100, 112), WORDS[12:24]))]
    refilled = item[0].replace("Zarumel", "Brinkast")
    for n in range(100, 112):
        refilled = refilled.replace(str(n), str(n + 500))
    got = found(spark, [refilled, item[0]], [(0, item[0] + " and lower zarumeli.")])
    assert got[(0, 0)]["n_slots_changed"] > 15 and got[(0, 0)]["consistent"] and got[(1, 0)]["n_slots_changed"] == 0
    mixed = refilled.replace("Brinkast", "Tolvenor", 5)
    assert not found(spark, [mixed], [(0, item[0])])[(0, 0)]["consistent"]


def test_repeats_empty_tables_and_very_long_texts(spark):
    long_ = "zqcorta " * 300000 + ITEMS[7][1] + " zqcorta" * 1000 + ITEMS[7][1]
    assert verbatim(spark, [long_, ITEMS[8][1], ITEMS[8][1]]) == {(0, 7), (1, 8), (2, 8)}
    assert verbatim(spark, []) == set() and verbatim(spark, ["text"], []) == set()
    assert verbatim(spark, [ITEMS[0][1]], [(1, None), (2, ""), (3, ITEMS[0][1])]) == {(0, 3)}


def test_items_asked_in_blocks_give_what_they_give_at_once(spark):
    texts = [f"zqa {ITEMS[i][1]} zqb" for i in range(6)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = spark.createDataFrame(ITEMS[:8], "item_id long, text string")
    pairs = lambda **k: sorted((r["doc_id"], r["item_id"]) for r in leakage.leaks(d, q, **k).filter(leakage.verbatim()).collect())
    assert pairs(block_chars=900) == pairs() == [(i, i) for i in range(6)]


@pytest.mark.parametrize("size,least", [(20, 0.6), (22, 0.85), (25, 0.95), (30, 0.99)])
def test_runs_of_about_twenty_words_with_one_changed(spark, size, least):
    rng = random.Random(size)
    noise = lambda n: " ".join("zq" + rng.choice(WORDS) for _ in range(n))
    items = [(i, " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(60))) for i in range(120)]
    texts, whole = [], []
    for _, text in items:
        run = text.split()[12 : 12 + size]
        whole.append(f"{noise(20)} {' '.join(run)} {noise(20)}")
        run[rng.randrange(1, size - 1)] = "changed"
        texts.append(f"{noise(20)} {' '.join(run)} {noise(20)}")
    assert len(verbatim(spark, whole, items)) == len(items)
    got = verbatim(spark, texts, items)
    assert all(a == b for a, b in got) and len(got) >= least * len(items)


LANGUAGES = {
    "en": "the estimator follows the measured phase and the boundary layer is close to the control group in the long run".split(),
    "de": "der gedämpfte Löser übertrifft deutlich die Grenzschicht und das zweite Gerät bestätigt nicht den Rauschpegel entlang der Hauptachse".split(),
    "ru": "наблюдаемый спектр почти полностью определяет пограничный слой и вторая установка подтверждает новый расчет после нескольких шагов".split(),
}


def paragraph(rng, lang, n=3):
    return " ".join(" ".join(rng.choice(LANGUAGES[lang]) for _ in range(9)).capitalize() + "." for _ in range(n))


def article(rng, *langs):
    head = "\\documentclass{article}\n\\title{Nothing here}\n\\begin{document}\n\\begin{abstract}\n"
    return head + paragraph(rng, langs[0]) + "\n\\end{abstract}\n\\section{Data}\n\n" + "\n\n".join(paragraph(rng, x) + " $x = 1$" for x in langs) + "\n\n% " + paragraph(rng, "ru").replace("\n", " ") + "\n\\begin{thebibliography}{9}\nThe title. And the other.\n\\end{thebibliography}\n\\end{document}"


def test_documents_and_segments_get_their_languages(spark):
    rng = random.Random(2)
    rows, want, parts = [], set(), {}
    for i in range(150):
        main = rng.choice(list(LANGUAGES))
        other = rng.choice(list(LANGUAGES)) if i % 10 == 0 else main
        label = rng.choice([main, {"en": "English", "de": "ger", "ru": "RU"}[main], f"{main}-XX"]) if i % 7 else rng.choice([None, "und", "", "de"])
        rows.append((i, label, article(rng, main, other, main), 1, "z"))
        parts[i] = {main, other}
        named = {"English": "en", "ger": "de", "RU": "ru"}.get(label, (label or "")[:2])
        want |= {(i, x) for x in parts[i] if x != named}
    rows += [(900, "en", None, 1, "z"), (901, None, "", 1, "z"), (902, "en", "\\begin{document}\n$x$\n\\end{document}", 1, "z"), (903, None, paragraph(rng, "de", 2000), 1, "z")]
    want.add((903, "de"))
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, segment int, label string")
    seg = languages.segments(df, languages.fit(df))
    assert {(r["doc_id"], r["lang"]) for r in languages.mislabelled(df, seg).collect()} == want
    top = {r["doc_id"]: r for r in languages.document_languages(seg).collect()}
    assert 900 not in top and 902 not in top and top[903]["lang"] == "de" and top[903]["confidence"] > 0.5
    mixed = [r for r in seg.collect() if r["doc_id"] % 10 == 0 and r["doc_id"] < 900 and len(parts[r["doc_id"]]) == 2]
    assert mixed and {r["n_paragraphs"] for r in mixed} <= {1, 2}


def test_far_texts_are_rejected_and_nothing_to_learn_from(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, "en", article(rng, "en")) for i in range(20)] + [(99, None, "ζηθικλ μνξοπρ στυφχψ ωαβγδε. κλμνξο πρστυφ χψωαβγ.")], "doc_id long, lang string, text string")
    assert {r["lang"] for r in languages.segments(df, languages.fit(df)).filter("doc_id = 99").collect()} == {None}
    none = df.limit(0)
    assert languages.segments(none, languages.fit(none)).count() == 0
    assert {r["lang"] for r in languages.segments(df, languages.fit(none)).collect()} == {None}


def test_accents_comments_and_headings():
    text = "A \\'e \\\"a \\c{c} \\~n \\ss{} b. % gone\nC \\% d.\n\n\\section{Gone {x}}\n\n\\begin{quote}Said so. Twice.\\end{quote}\n\\begin{equation} gone \\end{equation}"
    got = languages.running_paragraphs(text)
    assert " ".join(got[0].split()) == "A é ä ç ñ ß b. C d." and [p.strip() for p in got[1:]] == ["Said so. Twice."]
    assert len(languages._SENTENCE.findall("测得的相位明显优于下界。对于小样本。")) == 2


def test_held_out_accuracy():
    rng = random.Random(8)
    texts = [(x, paragraph(rng, x, 1)) for x in LANGUAGES for _ in range(80)]
    wrong = [(rng.choice(list(LANGUAGES)) if i % 12 == 0 else x, t) for i, (x, t) in enumerate(texts)]
    grams = languages.Grams()
    model = languages.train(grams.counts([t for _, t in wrong[::2]]), [x for x, _ in wrong[::2]])
    lang, sure = model.classify(grams.counts([t for _, t in texts[1::2]]))
    got = [model.languages[i] if i >= 0 else None for i in lang]
    assert np.mean([a == b for a, (b, _) in zip(got, texts[1::2])]) >= 0.98 and sure.min() >= 0


def test_labels_in_any_notation(spark):
    df = spark.createDataFrame([(x,) for x in ("en_US", "EN", "English", "fra", "pt-BR", "UK", "zho", "und", "unknown", "", None, " de ")], "lang string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(languages.label_language(F.col("lang"))).collect()] == ["en", "en", "en", "fr", "pt", "uk", "zh", None, None, None, None, "de"]
