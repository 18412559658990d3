import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from waymill.llm import langid
from waymill.llm.latex import not_prose
from waymill.llm.textplane import Plane

SAMPLES = {
    "en": "the path of the network is compared with the shortest route and this depends on the weight of each street in the city",
    "de": "der weg durch das netz wird mit der kürzesten verbindung verglichen und das hängt vom gewicht jeder straße in der stadt ab",
    "fr": "le chemin du réseau est comparé avec la route la plus courte et cela dépend du poids de chaque rue dans la ville",
    "ru": "путь в сети сравнивается с самой короткой дорогой и это зависит от веса каждой улицы в городе",
}
DOCS = "doc_id bigint, text string, lang string"


def prose(text):
    begins, ends, _ = not_prose(text)
    hidden = {k for a, b in zip(begins, ends) for k in range(a, b)}
    return " ".join("".join(c if k not in hidden else " " for k, c in enumerate(text)).replace("{", " ").replace("}", " ").split())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a % note\nb 5\\% c", "a b 5 c"),
        ("a $x^2$ b \\(y\\) c \\[z\\] d $$w$$ e", "a b c d e"),
        ("\\begin{equation} x \\label{q} \\end{equation} after \\begin{align*}1\\end{align*}", "after"),
        ("see \\cite[p. 3]{abc} and \\ref{x}, \\emph{very} \\textbf{good} \\textcolor{red}{paint}", "see and , very good paint"),
        ("\\newcommand{\\x}[1]{some #1 text} \\def\\y#1{more \\textit{#1}} rest", "rest"),
        ("\\def\\y" + " " * 300 + "{secret words here} rest", "rest"),
        ("\\def\\y\n\n{a group} of the next paragraph", "a group of the next paragraph"),
        ("\\section{Title}\\label{s} text\\footnote{note} more", "Title text note more"),
        ("a \\begin{thebibliography}{9} \\bibitem{k} Names \\end{thebibliography} b", "a b"),
        ("a \\begin{thebibliography}{9} cut off", "a"),
        ("\\begin{figure}[h]\\includegraphics[width=3 mm]{f}\\caption{A view}\\end{figure}", "A view"),
        ("open $x and then\n\nnext paragraph", "open next paragraph"),
        ("\\begin{otherlanguage}{german} wort \\end{otherlanguage}", "wort"),
        ("\\documentclass[11pt]{article}\\usepackage[utf8]{inputenc} x", "x"),
        ("", ""), ("\\", ""), ("{", ""), ("}", ""), ("$", ""), ("\\begin{", ""), ("%", ""),
    ],
)
def test_prose(text, want):
    assert prose(text).replace("\\", "").strip() == want


@pytest.mark.parametrize("piece", ["\\(", "\\(a\\)", "\\[", "$", "$$", "{", "}", "\\cite{", "\\cite[", "\\def", "\\def\\x", "\\begin{equation}", "\\begin{", "\\footnote{a ", "%", "\\", "\n\n", "\\(\n\n", "\\newcommand{\\a", "word "])
def test_long_odd_texts_take_linear_time(piece):
    began = time.process_time()
    not_prose(piece * 100_000)
    assert time.process_time() - began < 5


def model():
    texts, labels = [], []
    for lang, text in SAMPLES.items():
        words = text.split()
        for k in range(0, len(words), 3):
            texts.append(" ".join(words[k:] + words[:k])), labels.append(lang)
    return langid.fit(texts, labels)


def samples(spark):
    return spark.createDataFrame([(t, g) for g, t in SAMPLES.items()] * 5 + [(None, "en"), ("x", None)], "text string, lang string")


def test_passages_and_confidence():
    labeller = langid.Labeller(model(), 12.0)
    en, de = SAMPLES["en"] + ". ", SAMPLES["de"] + ". "
    found = labeller.label(Plane(["", en * 5 + "\\footnote{" + de * 3 + "}" + en * 2, de, "$x$"]))
    names = labeller.model.languages
    rows = [(int(t), names[k], int(w)) for t, k, w in zip(found["text"], found["language"], found["words"])]
    n, m = len(SAMPLES["en"].split()), len(SAMPLES["de"].split())
    assert rows == [(1, "en", 5 * n), (1, "de", 3 * m), (1, "en", 2 * n), (2, "de", m)]
    assert (found["confidence"] > 0.8).all() and (found["confidence"] <= 1).all()


def test_issues(spark):
    en, de, ru = (SAMPLES[k] + ". " for k in ("en", "de", "ru"))
    docs = [
        (1, en * 3, "en"), (2, en * 3, "English"), (3, en * 3, "EN-us"), (4, en * 3, None), (5, en * 3, " "), (6, en * 3, "und"), (7, en * 3, "ger"), (8, en * 3, "Italian"), (9, en * 6 + "\n\n" + de * 3, "eng"),
        (10, en * 6 + "% " + de * 3, "en"), (11, "few words", None), (12, None, None), (13, "", "en"), (14, "$" + en + "$", None), (15, ru * 4, "ru_RU"), (16, en * 30_00, "de"), (4, en * 3, None),
    ]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "'z' AS given", "1 AS language", "2 AS words")
    found = langid.passages(df, samples(spark))
    got = {(r["doc_id"], r["issue"], r["true_lang"]) for r in langid.label_issues(found).collect()}
    assert got == {(4, "missing", "en"), (5, "missing", "en"), (6, "missing", "en"), (7, "wrong", "en"), (8, "wrong", "en"), (9, "mixed", "de"), (16, "wrong", "en")}
    by = {r["doc_id"]: r for r in langid.document_languages(found).collect()}
    assert set(by) == set(range(1, 17))
    assert by[12]["language"] is None and by[13]["prose_words"] == 0 and by[15]["language"] == "ru" and by[1]["confidence"] > 0.4


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert langid.passages(none, samples(spark)).collect() == []
    rows = langid.passages(spark.createDataFrame([(1, "some words", "en")], DOCS), samples(spark).limit(0)).collect()
    assert len(rows) == 1


@pytest.mark.parametrize(("label", "want"), [("en", "en"), ("EN_gb", "en"), ("deu", "de"), ("Ger", "de"), ("dutch", "nl"), ("pt-BR", "pt"), ("xx", None), ("und", None), ("??", None), ("", None), (None, None), ("zho", "zh"), ("ru.UTF-8", "ru")])
def test_named_language(spark, label, want):
    assert spark.createDataFrame([(label,)], "l string").select(langid.named_language(F.col("l"))).first()[0] == want


def test_held_out_accuracy_on_given_samples(spark, data):
    rows = spark.read.parquet(f"{data}/lang_samples.parquet").select("text", "lang").collect()
    fitted = langid.fit([r[0] for r in rows[::2]], [r[1] for r in rows[::2]])
    labeller = langid.Labeller(fitted, 12.0)
    rest = rows[1::2]
    found = labeller.label(Plane([r[0] for r in rest]))
    best = {}
    for t, k, w in zip(found["text"].tolist(), found["language"].tolist(), found["words"].tolist()):
        best.setdefault(t, {}).setdefault(k, 0)
        best[t][k] += w
    right = sum(fitted.languages[max(v, key=v.get)] == rest[t][1] for t, v in best.items())
    assert right / len(rest) > 0.97
    assert 0 < len(fitted.grams) and Path(data).exists()


def test_many_macros_without_a_body_take_linear_time():
    began = time.perf_counter()
    not_prose("\\def\\a " * 100_000)
    assert time.perf_counter() - began < 5


def test_sample_is_bounded_in_rows_and_characters(spark):
    df = spark.createDataFrame([(f"text {k} " * 10, "en") for k in range(50)] + [("x" * 5000, "de"), (None, "fr")], "text string, lang string")
    texts, labels = langid.training_rows(df, "text", "lang", 20, 10**6)
    assert len(texts) == 20
    texts, labels = langid.training_rows(df, "text", "lang", 50, 1000)
    assert 5 < len(texts) < 20 and sum(map(len, texts)) <= 1000 and set(labels) == {"en"}


def test_confidences_of_the_model_in_use_are_reliable(spark, data):
    rows = spark.read.parquet(f"{data}/lang_samples.parquet")
    model = langid.fitted(*langid.training_rows(rows, "text", "lang", 20_000, 4_000_000))
    assert model.held_out > 0.95 and model.reliability < 0.03
    assert langid.fitted(*langid.training_rows(rows, "text", "lang", 20_000, 4_000_000)) is model


def test_several_labels_of_one_key(spark):
    found = spark.createDataFrame([(1, "nl", "en", 40, 0.9, 0, 9, 40), (1, "en", "en", 40, 0.9, 0, 9, 40), (2, None, "de", 40, 0.9, 0, 9, 40)], "doc_id bigint, given string, language string, words bigint, confidence double, begin bigint, end bigint, prose_words bigint")
    assert {tuple(r) for r in langid.label_issues(found).collect()} == {(2, "missing", "de")}
    assert {(r["doc_id"], r["given"], r["language"]) for r in langid.document_languages(found).collect()} == {(1, "en", "en"), (2, None, "de")}
