"""Template residue, filler, error pages and notices on sentences of the domain and of none."""

import pytest

from other_pages import NEGATIVE, POSITIVE
from vislake.llm.residue import find_residue, flattened, line_key, lines, placeholders, segments

REPORT = "Receiver two at ALPHA is warm; expect 54.0 K instead of the usual value until the pump is replaced."


@pytest.mark.parametrize("form", ["{{tsys}}", "{{{tsys}}}", "{{ tsys|default }}", "{% tsys %}", "<%= tsys %>", "${tsys}", "${tsys:-}", "#{tsys}", "{tsys}", "{0}", "{}", "｛tsys｝", "@@tsys@@", "~tsys~", "::tsys::", "%(tsys)s", "%s", "%1$s", "%tsys%", "$tsys$", "__tsys__", "____", "[[tsys]]", "[tsys here]", "[your tsys]", "[…]", "<!-- tsys -->", "<<tsys>>", "<enter tsys>", "<...>", "«tsys»", "&lt;tsys&gt;", "&#123;&#123;tsys&#125;&#125;", "TBD"])
def test_placeholders_where_a_value_should_stand(form):
    assert placeholders(f"Receiver two at ALPHA is warm; expect {form} K until the pump is replaced.")
    assert placeholders(f"{REPORT} " * 500 + f"The drift is {form} ps.")


@pytest.mark.parametrize("text", [
    "In the report template every `{{antenna}}` is replaced with the station name.", 'Use printf "%s %d" to write the scan name.', "Entries written as <antenna> in the manual mean the name.", "Cells marked [TBD] in the old table now hold 3.",
    'Array c[[0]] of the log and map {"1445-000": 73.8} were compared by eye.', r"We fit T = a + b \cdot \sec{z} with \frac{b}{a} = 0.", "The shell wrapper reads ${FRINGE_DIR} and falls back.", 'The loop prints "$(ant): $(round(tsys))" for each antenna.',
    "<html><body><p>Fringes were found.</p></body></html>", "The gain is 50 % of the old one, see [1] and (2).", "**bold** and `code` and a < b > c", REPORT, "", "Set `pattern = \"{src}_{epoch}.mod\"` in the configuration.",
])
def test_forms_that_are_the_subject_are_none(text):
    assert placeholders(text) == []


def _kinds(text):
    return {k for _, _, k in segments(flattened(text)) if k}


@pytest.mark.parametrize("kind,text", [
    ("script", "Please enable\nJavaScript and reload the page."), ("script", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen."), ("script", "Les scripts sont bloqués par votre navigateur."), ("script", "ESTE SITIO NECESITA JAVASCRIPT PARA FUNCIONAR."),
    ("error", "404 Not Found"), ("error", "HTTP Status 410 - Gone"), ("error", "Zugriff verweigert"), ("error", "Une erreur est survenue"), ("error", "There is no document /logs/vx000169 on this server."), ("error", 'Traceback (most recent call last): File "view.py", line 3'),
    ("filler", "Lorem ipsum dolor sit amet."), ("filler", "foo bar asdf asdf qwerty zzz"), ("filler", "Your text goes here."), ("filler", "Texte d'exemple à remplacer."), ("filler", "Überschrift eingeben"),
])
def test_evidence(kind, text):
    assert _kinds(text) == {kind}


@pytest.mark.parametrize("text", ["The status page of ALPHA needs JavaScript, so we read the counters over the serial line instead.", "The archive answered 404 Not Found for the first upload of scan 3.", "A 503 from the clock server at 12:30 left a hole.", "Placeholder zeros in the weather file of ALPHA were removed before the run.", REPORT])
def test_reports_are_no_evidence(text):
    assert _kinds(text) == set()


@pytest.mark.parametrize("text", ["Curabitur pretium tincidunt lacus nulla gravida", "Sed ut perspiciatis unde omnis iste natus", "Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas", "Vivamus sagittis lacus vel augue laoreet rutrum faucibus"])
def test_other_dummy_latin(text):
    assert _kinds(text) == {"filler"}


@pytest.mark.parametrize("text", ["Receiver current offset limit status monitor", "Antena parada viento fuerte lluvia intensa", "Mesures normales, horloge stable, récepteur froid, météo claire", "Empfänger kalt, Maser stabil, Wetter klar, Kabel ruhig", "El dolor en la mano fue culpa del viento"])
def test_terse_lines_are_no_latin(text):
    assert _kinds(text) == set()


@pytest.mark.parametrize("kind,text", [("error", "503 Service Unavailable at 12:45 UTC"), ("script", "You see this because JavaScript is disabled.")])
def test_small_additions_do_not_void_evidence(kind, text):
    assert _kinds(text) == {kind}


def test_phrases_across_line_ends_and_quotations():
    assert [k for _, _, k in segments(flattened("All is well here today.\nPlease enable\nJavaScript now. The pump runs."))] == [None, "script", None]
    assert _kinds('"404 Not Found" again') == set() and _kinds('"404 Not Found"') == {"error"}
    assert lines("One line. " * 2000) == [("one line. " * 1999 + "one line", 19_998, 0)] and lines("") == []
    assert [(k, c) for k, _, c in lines("A b. C d. 404 Not Found. E {{f}} g. H i. J k.\nL m.")] == [("a b. c d", 0), ("0 not found", 3), ("e {{f}} g", 1), ("h i. j k", 0), ("l m", 0)]


def test_recurrent_lines_are_subtracted_whatever_they_say(spark):
    """A footer beside content is boilerplate though it has an error phrase; the message of a host's error pages is not."""
    footer, words = "If this page does not load, please try again later.", "alpha beta gamma delta kappa omega sigma theta".split()
    story = "The {} crew measured the drift by hand and wrote {} pages of notes about what they saw that night."
    rows = [(k, "site", f"Menu Search Login\n{story.format(a, a)}\n{footer}") for k, a in enumerate(words)]
    rows += [(20 + k, "site", f"Menu Search Login\nSorry, something went wrong\n{a}") for k, a in enumerate(words)]
    rows += [(40, "site", f"short\n{footer}"), (41, "elsewhere", f"short\n{footer}")]
    got = find_residue(spark.createDataFrame(rows, "doc_id bigint, host string, text string")).collect()
    assert sorted((r["doc_id"], r["kind"]) for r in got) == [*[(20 + k, "error") for k in range(8)], (41, "error")]


def test_on_pages_written_apart(spark):
    """Held out: nothing was fitted to these texts (see other_pages.py)."""
    every = [(k, text) for k, (_, text) in enumerate(POSITIVE)] + [(1000 + k, text) for k, text in enumerate(NEGATIVE)]
    found = {r["doc_id"] for r in find_residue(spark.createDataFrame(every, "doc_id bigint, text string").selectExpr("*", "cast(doc_id as string) host")).collect()}
    hits = sum(k < 1000 for k in found)
    assert hits / len(POSITIVE) >= 0.85 and len(found) == hits


def test_records(spark):
    menu = "Menu Search Login and many more entries of this portal"
    rows = [(k, "site", f"{menu} {0}\n{REPORT} Number {'abcdefgh'[k]} of the list here.") for k in range(4)]
    rows += [
        (10, "site", f"{menu} 7\n404 Not Found"), (11, "site", f"{REPORT}\n404 Not Found"), (12, "site", f"{REPORT} The drift is {{{{value}}}} ps."), (13, "other", "Lorem ipsum dolor sit amet. Dolor ipsum."),
        (14, "other", f"{REPORT} {REPORT} Lorem ipsum dolor sit."), (15, None, "JavaScript is disabled in your browser."), (16, "site", ""), (17, "site", None), (18, "site", REPORT * 3000), (13, "other", "Lorem ipsum dolor sit amet. Dolor ipsum."),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, host string, text string").selectExpr("*", "'x' lines", "'y' kind")
    got = sorted((r["doc_id"], r["kind"]) for r in find_residue(df).collect())
    assert got == [(10, "error"), (12, "placeholder"), (13, "filler"), (13, "filler"), (15, "script")]
    assert find_residue(df.where("false")).count() == 0
    # Without the other texts of the host its menu is content, and the page is not mainly an error.
    alone = df.where("doc_id = 10").selectExpr("doc_id", "host", "concat(text, '\n', repeat('One more sentence of quite ordinary page content. ', 4)) text")
    assert find_residue(alone).count() == 0


def test_short_lines_are_content(spark):
    log = "\n".join(f"Recorder module {x} changed" for x in ("alpha", "beta", "gamma", "delta", "kappa"))
    table = " | ".join(f"Tsys{x} 5{k}.0 K" for k, x in enumerate("abcdefgh"))
    rows = [(1, "a", f"{log}\nconnection refused"), (2, "b", f"{table}\nserver busy"), (3, "c", "\n".join(["54.0", "hot", "wet", "dry", "cold"] * 9) + "\nserver busy"), (4, "d", "Portal\nserver busy")]
    got = find_residue(spark.createDataFrame(rows, "doc_id bigint, host string, text string"))
    assert [(r["doc_id"], r["kind"]) for r in got.collect()] == [(4, "error")]


def test_lines_are_normalised():
    assert line_key("  - Page generated 2023-08 in 0.71 s ") == line_key("PAGE  generated 2024-11 in 10.5 s")
