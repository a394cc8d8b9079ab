import random

import pytest

from quire.llm import phrases, residue

SCHEMA = "doc_id bigint, text string, n_placeholders string"
CASES = [
    ("Please enable JavaScript to view this page.", True),
    ("The cone is bounded.\n\nError 404: page not found", True),
    ("The cone is bounded. Diese Seite benötigt JavaScript.\r\nThe bound holds.", True),
    ("# {{ title }}\n\nThe cone is bounded.", True),
    ("The cone %s is bounded by $x_1$.", True),
    ("\\title{<%= name %>}", True),
    ("Review by [Your Name], done.", True),
    ("Your abstract goes here.", True),
    ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", True),
    ("vesta canit sidera tonat. rupes quintus alebat fugae morandi sero.", True),
    ("We write `{{ title }}` and \"Error 404: page not found\" in the guide.", False),
    ("```\n{{ title }}\nPlease enable JavaScript to view this page.\n```\nThe cone is bounded.", False),
    ("The constant is $\\frac{{a_n}}{{b_n}}$, and ${m}$ is its order.", False),
    ("Access to the ledger is denied to scripts by design, and a failed request is an internal error of the client.", False),
    ("Filler such as “lorem ipsum dolor sit amet” must never reach a release.", False),
    ("The set has 404 elements, and the error of the scheme is small.", False),
    ("", False),
    (None, False),
    ("  \n\t", False),
]


WORDS = {
    "en": "cone bound kernel limit weight profile spectrum lattice holds is depends on the proof uses step line reader claim section compares",
    "de": "der Satz des Artikels folgt aus dem ersten Lemma und die Schranke gilt nur im Abschnitt wenn das Gewicht klein ist wie der Autor zeigt",
    "fr": "le théorème de la section suit du lemme et la borne ne vaut que si le poids est petit comme le montre l'auteur dans cet article",
    "es": "el teorema de la sección se sigue del lema y la cota solo vale si el peso es pequeño como muestra el autor del artículo en el resultado",
}


def prose(rng, n, lang="en"):
    words = WORDS[lang].split()
    return [" ".join(rng.choice(words) for _ in range(rng.randint(20, 60))) + "." for _ in range(n)]


@pytest.fixture(scope="module")
def flagged(spark):
    rng = random.Random(1)
    filler = "lorem ipsum vesta canit sidera tonat rupes quintus alebat fugae morandi sero dolor".split()
    rows = [(k, text, "clash") for k, (text, _) in enumerate(CASES)]
    rows += [(1000 + k, text, "clash") for k, text in enumerate(prose(rng, 300))]
    rows += [(5000 + k, "Lorem ipsum dolor sit amet, " + " ".join(rng.choice(filler) for _ in range(30)) + ".", "") for k in range(40)]
    rows.append((9000, "x " * 200_000 + "\n" + "{" * 5000 + '"' * 3001, ""))
    df = spark.createDataFrame(rows + rows[:1], SCHEMA)
    scored = residue.score(df)
    assert scored.count() == len(rows) + 1
    return [r.doc_id for r in residue.residual(scored).collect()]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_cases(flagged, k):
    assert (k in flagged) == CASES[k][1], CASES[k][0]


def test_corpus(flagged):
    assert flagged.count(0) == 2
    assert not [k for k in flagged if 1000 <= k < 5000 or k == 9000]
    assert sum(k >= 5000 for k in flagged) >= 30


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert residue.score(df).count() == 0


PAGES = {
    "filler": "Lorem ipsum dolor sit amet, consectetur adipiscing elit. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore.",
    "notice": "Access denied. Your session has expired. Please log in again.",
    "prompt": "Your abstract goes here. Insert the main theorem in this place. Replace this paragraph with the motivation of the article.",
}


def test_a_third_of_the_rows_are_copies(spark):
    rows = [(k, text) for k, text in enumerate(prose(random.Random(2), 6000))]
    for name, page in PAGES.items():
        copies = [(10_000 + k, page) for k in range(3000)]
        got = {r.doc_id for r in residue.residual(residue.score(spark.createDataFrame(rows + copies, "doc_id bigint, text string"))).collect()}
        assert got == {k for k, _ in copies}, name


def test_found_notices_are_no_prose(spark):
    rng = random.Random(4)
    notices = [residue.normal(t).strip(".") for t in [phrases.expand(p)[0] for p in phrases.PATTERNS["notice"]] if len(t) > 20]
    rows = [(k, text) for k, text in enumerate(prose(random.Random(2), 6000))]
    rows += [(10_000 + k, ", ".join(rng.choice(notices) for _ in range(12))) for k in range(3000)]
    got = [r.doc_id for r in residue.residual(residue.score(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()]
    assert min(got) >= 10_000 and len(got) >= 0.98 * 3000


LONG = "the notice of the server was kept in the log of the run, " * 12


@pytest.mark.parametrize("marks", ["\"\"", "“”", "„“", "«»", "‹›", "「」", "$$"])
def test_quotations_of_any_length(marks):
    text = f"{marks[0]}{LONG}{marks[1]} Please enable JavaScript. {marks[0]}{LONG}{marks[1]} ends"
    assert residue.spoken_out(text) == "￼ Please enable JavaScript. ￼ ends"


def test_quotations_end_with_the_paragraph():
    assert residue.spoken_out("a “b\nc” d “e\n\nf” \"g\nh\" \"i\n \nj\"") == "a ￼ d “e\n\nf” ￼ \"i\n \nj\""
    assert residue.spoken_out("«NAME» « a» ““”” “”") == "«NAME» ￼ ￼” “”"
    assert len(residue.spoken_out("«„‹「" * 200_000)) == 800_000


@pytest.mark.parametrize("text", [f"[Insert {LONG}]", "<your " + "long " * 30 + "name>", "{% include " + "long " * 30 + "%}"])
def test_prompts_of_any_length(text):
    seen = []
    assert residue.placeholders(f"a {text} b", lambda window: seen.append(window) or True) == 1 and seen


#: Texts that no pattern gives, with what they are.
HELD_OUT = [
    "Sorry, the document you wanted is no longer available on this server.", "Gateway timeout: the backend server did not answer in time.", "You must turn on JavaScript in your browser to use the catalogue.",
    "Error 500 - an internal server error has occurred. Try again later.", "The requested chapter was not found on this server.", "This library viewer requires JavaScript to display the content.",
    "Access denied: you don't have permission to view the archive.", "Your login session has timed out. Please log in again.", "Too many requests. Please try again in 60 seconds.",
    "Le service est momentanément indisponible. Veuillez réessayer plus tard.", "Cette bibliothèque nécessite JavaScript pour fonctionner.", "Erreur 404 : cette page est introuvable.",
    "Bitte aktivieren Sie JavaScript, um den Katalog zu sehen.", "Fehler 404: Das Dokument wurde nicht gefunden.", "Der Dienst ist vorübergehend nicht erreichbar.",
    "Por favor, active JavaScript en su navegador para ver el catálogo.", "Error 404: el archivo no se ha encontrado.", "El servicio no está disponible en este momento.",
    "Insert your acknowledgements here.", "Replace this text with a description of the data.", "Enter the title of your paper here.", "Your biography goes here.", "TODO: write the introduction.",
    "Insérez ici votre conclusion.", "Remplacez ce texte par votre conclusion.", "Hier die Einleitung einfügen.", "Ersetzen Sie diesen Text durch Ihre Einleitung.", "Escriba aquí su texto.", "Inserte aquí su conclusión.",
    "Lorem ipsum dolor sit amet, aliquip nostrud tempor.", "Sed do eiusmod tempor, quis nostrud laboris nisi.",
]
HELD_OUT_PROSE = [
    "The server that kept the archive was replaced last year, and the page numbers have changed since.", "We found no error in the proof of the main theorem.", "The title of the section was changed after the review.",
    "A page that needs scripts is rendered by the build before it is indexed.", "The reader who wants the details is referred to the third section.", "Access to the data was granted by the editors of the journal.",
    "Der Beweis des Satzes steht im dritten Abschnitt des Artikels.", "Le titre de la section résume le théorème principal.", "El resumen del artículo describe el resultado principal.",
]


def test_held_out_texts(spark):
    given = {t for patterns in phrases.PATTERNS.values() for p in patterns for t in phrases.expand(p)}
    assert not given & set(HELD_OUT)
    rows = [(k, text) for k, text in enumerate([*HELD_OUT, *HELD_OUT_PROSE, *(t for lang in WORDS for t in prose(random.Random(6), 500, lang))])]
    got = {r.doc_id for r in residue.residual(residue.score(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    assert len([k for k in range(len(HELD_OUT)) if k in got]) >= 0.9 * len(HELD_OUT), [HELD_OUT[k] for k in range(len(HELD_OUT)) if k not in got]
    assert not {k for k in got if k >= len(HELD_OUT)}


def test_copies_of_placeholders_are_no_prose(spark):
    rows = [(k, text) for k, text in enumerate(prose(random.Random(8), 3000))] + [(10_000 + k, f"Name {k}: {{{{ title }}}} and ${{VENUE}} {k}") for k in range(1500)]
    got = [r.doc_id for r in residue.residual(residue.score(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()]
    assert min(got) >= 10_000 and len(got) == 1500


def test_placeholders_before_many_different_words_are_no_prose(spark):
    rng = random.Random(9)
    kinds = ["{0}", "%s", "{}", "[object Object]", "[[TITLE]]", "<TITLE HERE>", "__DATE__", "%%YEAR%%"]
    held = [f"The cone {kinds[k % len(kinds)]} {rng.choice('([,;:-=')}{text}" for k, text in enumerate(prose(rng, 3000))]
    powers = [f"Then x^{{{k % 10}}} and \\cite{{{k % 9}}} {rng.choice('([,;:-=')}{text}" for k, text in enumerate(prose(rng, 3000))]
    rows = list(enumerate(held + powers))
    got = {r.doc_id for r in residue.residual(residue.score(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    assert got == set(range(len(held))), {kinds[k % len(kinds)] for k in set(range(len(held))) - got}


def test_windows_of_prose_hold_no_placeholder():
    assert residue.filled("{a} of {0} [see %s here] and [[TITLE]] x^{2}") == "{a} of ￼ [see ￼ here] and ￼ x^{2}"
