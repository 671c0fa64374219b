import time

import pytest

from lodepath.llm import residue as R

CASES = {
    "template": [
        "Dear {{ company_name }}, thank you.", "Join ${shift} as our next %(start_date)s.", "Pay: <%= salary %>.", "In [[location]] we work.", "Site: #SHIFT#.", "Hello *|FNAME|* and welcome", "As @@job_title@@ you",
        "Nobody works <Insert start date> people.", "Nous (votre intitulé du poste) jours", "Wir suchen [ABTEILUNG] Kräfte", "busca (su departamento) en", "Pay: XXXXX.", "Join [object Object] now", "We need undefined trailers.", "Travel to undefined is possible.", "Kataloge, (bitte eintragen: stellenbezeichnung) und Ruhe", "<Bitte eintragen: abteilung>",
        "&lt;lieu&gt; recrute.", "Reports to: _______ (manager)", "is hiring a {job_title}!", "[TODO: contact email]", "@Model.Benefits", ":LOCATION: is near", "«JobTitle» gesucht", "__JOB_TITLE__", "$DEPARTMENT$", "{0} is hiring",
    ],
    "filler": ["Lorem ipsum dolor sit amet consectetur", "Text. blah blah blah blah blah. More.", "This is dummy text for the layout preview.", "Beschreibung folgt.", "Aquí va el texto del puesto.", "Descripción pendiente.", "jjklö fdsaj hjkl asdfj lkjh gfdsa hjkl"],
    "script": ["Please enable JavaScript and cookies to continue.", "PLEASE ENABLE JAVASCRIPT TO VIEW THIS PAGE", "<noscript>You have to turn on JavaScript to read this job advert</noscript>", "Für diese Seite werden Skripte benötigt.", "Votre navigateur bloque les scripts nécessaires à cette page.", "Activa JavaScript para ver la oferta."],
    "error": ["Real words here. 404 Not Found", "Access denied. You do not have permission to view /jobs/74.", "Zugriff verweigert (503).", "Erreur 504 : page introuvable.", "Se ha producido un error.", "Could not connect to database 'postings' on 4f281f87d79c1854 (errno 46)", "Service Unavailable (503) upstream 6470fe4a did not answer within 10 seconds"],
}
CLEAN = [
    None, "", " ", "<p></p>", "You will restyle the 404 page and write kinder 500 messages.", "Designers here swap lorem ipsum for real copy before anything ships.", "Solid JavaScript required, and please enable others to learn it from you.",
    "You will write {{ mustache }} templates and ${shell} snippets for the mail team.", "Tags such as [Remote] or [Night Shift] mark the rota.", "Our stack is {PostgreSQL, Redis, Kafka} with small services around it.",
    "Know when a log call wants %s and when it wants {0}.", "Grade [Level 3] pays 5% more than [Level 2].", "You fix 'undefined is not a function' faults in the booking form.", "Tidy __init__ modules and #todo# notes are welcome.",
    "The ad templates use [[ ]] marks; you make sure none is left unfilled.", "When a reader sees 'access denied' at the gate, you reset the card.", "JavaScript is required for this post; TypeScript helps.",
    "We pay 10% (gross) and offer lunch (free).", "Pay < 100 and > 50.", "C# and C++; e-mail: a@b.example; 100% #1 $5", "a" * 200_000,
]


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in CASES.items() for t in ts])
def test_found(kind, text):
    assert kind in {k for k, _ in R.residue(text)}, R.residue(text)
    assert kind in {k for k, _ in R.residue(f"<p>We pack crates in Fenmere.</p>\n<p>{text}</p>")}


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert R.residue(text) == []


@pytest.mark.parametrize(("left", "right"), [("{{ ", " }}"), ("{{{", "}}}"), ("${", "}"), ("<%= ", " -%>"), ("{% ", " %}"), ("[[ ", " ]]"), ("<<", ">>")])
def test_long_slots(left, right):
    inner = "insert the name of the hiring manager and the department and the full address of the site at which the shift begins"
    assert ("template" in {k for k, _ in R.residue(f"We pack crates with {left}{inner}{right} each day.")}) and len(inner) > 100


@pytest.mark.parametrize("text", ["{{" + "a " * 100_000, "{{" * 50_000, "{{" + " " * 100_000 + "x", "<<" + "b " * 100_000, "__" + "A_" * 100_000])
def test_open_marks_take_linear_time(text):
    began = time.monotonic()
    R.residue(text)
    assert time.monotonic() - began < 10


def test_without_the_library(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    R.automaton.cache_clear()
    try:
        for kind in ("script", "error", "filler"):
            for t in CASES[kind]:
                assert kind in {k for k, _ in R.residue(t)}
    finally:
        R.automaton.cache_clear()


def test_frame(spark):
    rows = [(1, CASES["error"][1], "k"), (2, "Fine.", "k"), (2, None, "k"), (1, CASES["error"][1], "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kinds string")
    got = R.find_residue(df, "doc_id", "text").collect()
    assert [r.id for r in got] == [1, 1] and got[0].coverage > 0.9
    assert R.find_residue(df.limit(0), "doc_id", "text").count() == 0
