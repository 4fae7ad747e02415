import pytest

from sievework.llm import personal as P

F = P.finder()


@pytest.mark.parametrize(
    "text,want",
    [
        ("Mail: anna.k@example.org", ["EMAIL"]), ("write to anna (at) post (dot) example", ["EMAIL"]), ("My name is Anna Korquist and you can reach me at a_k@post.example.", ["NAME", "EMAIL"]), ("call me back on (020) 7946-0329 after six", ["PHONE"]), ("Tel. +33 1 99 00 30 46", ["PHONE"]),
        ("ring 552\u00a0555\u00a00108", ["PHONE"]), ("SSN: 559393478", ["ID_NUMBER"]), ("131-10-4517", ["ID_NUMBER"]), ("passport KYK9Z09JK", ["ID_NUMBER"]), ("DNI 53501499A", ["ID_NUMBER"]), ("n° 1 85 10 81 273 488 06", ["ID_NUMBER"]), ("Ship it to 216 Bellfounder Ave, Apt 5", ["ADDRESS"]),
        ("Birkenweg 72, 94755 Falkental", ["ADDRESS"]), ("Vivo en Calle del Olivo 108, bajo, 41528 Villarroble.", ["ADDRESS"]), ("157 bis, rue des Tilleuls, 30726 Saint-Aubrac", ["ADDRESS"]), ("P.O. Box 2459, Tidewick", ["ADDRESS"]), ("Kind regards,\nKatrin Primgaard", ["NAME"]), ("Customer: Korlorn, Thea", ["NAME"]),
        ("Yesterday Dr. Gorekova repaired it", ["NAME"]), ("As Dario Lamdray told me", ["NAME"]),
    ],
)
def test_found(text, want):
    assert [s.kind for s in F.spans(text)] == want


@pytest.mark.parametrize(
    "text",
    ["", " ", "git@code.example:team/tool.git", "@lumen/widgets@5.30.0", "icon-1b0272da9@9x.png", "cron@daily", "SELECT a@b FROM t", "order 204786-5129414", "batch 112-354-18", "invoice 449-976-5735", "lot 385-06-4231 of flour", "range 253-45-1849 ms", "timestamp 1593387027", "build 2.03.922.5782",
     "ISBN 978-0-5044-2921-4", "street lamp 8434", "Route 71 bus stop", "slot 30 court schedule", "Copper Kettle Ltd", "Ashcombe Bakery & Sons", "Project Amber Heron", "Falcon Ridge dashboard", "192.0.2.141", "ssh ops@queue.test", "In 1957, the mill sold the bridge.", "a " * 40_000],
)
def test_clean(text):
    assert F.spans(text) == [] and F.redact(text) == text


def test_validators():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")
    assert P.mod97("GB82 WEST 1234 5698 7654 32") and not P.mod97("GB83 WEST 1234 5698 7654 32")
    assert P.insee("185108127348806") == (97 - 1851081273488 % 97 == 6) and P.control_letter("12345678", "Z") and not P.control_letter("12345678", "A")
    assert P.ssn_range("131", "10", "4517") and not P.ssn_range("666", "10", "4517") and not P.ssn_range("131", "00", "4517")


def test_redaction_reads_on():
    assert F.redact("My name is Anna Korquist, call 020 7946 0086.") == "My name is [NAME], call [PHONE]."


def test_spans_never_overlap_and_redaction_leaves_nothing():
    text = "Tenant Mara Velworthy lives at 24 Ropewalk Blvd, Bramstoke 93711, mail mara.v@post.example, SSN 131-10-4517"
    spans = F.spans(text)
    assert len(spans) == 4 and all(a.end <= b.start for a, b in zip(spans, spans[1:], strict=False))
    assert F.spans(F.redact(text)) == []


def test_table(spark):
    rows = [(1, "a\nMail: x.y@example.org and z.w@example.org\nTel. 020 7946 0086", "k"), (2, None, "k"), (3, "", "k"), (4, "Mail: x.y@example.org", "k"), (5, "Mail: x.y@example.org", "k")]
    df = spark.createDataFrame(rows, "id long, t string, pii_type string")
    got = sorted(tuple(r) for r in P.personal_lines(df, "id", "t").collect())
    assert got == [(1, 2, "EMAIL"), (1, 3, "PHONE"), (4, 1, "EMAIL"), (5, 1, "EMAIL")]
    assert P.personal_lines(df.limit(0), "id", "t").count() == 0


@pytest.mark.parametrize(
    "text",
    ["Birkenweg 5", "5 rue Pasteur", "5, rue Pasteur", "5bis rue Pasteur", "12bis rue Victor Hugo", "12bis, rue Victor Hugo", "12 bis rue Victor Hugo", "7ter chemin du Lac", "3 quai Voltaire", "Postfach 7", "postfach7", "p.o. box 4", "apartado de correos 9", "boîte postale 3", "BP 8",
     "Calle Mayor 5", "C/Mayor, 5", "Plaza Mayor, 3", "Lindenstr. 4", "5 Elm St", "4 N Mill Road", "Am Anger 3, 94755 Falkental"],
)
@pytest.mark.parametrize("alone", [False, True])
def test_addresses_whose_only_sign_is_a_house_number(text, alone):
    assert [s.kind for s in F.spans(text, alone)] == ["ADDRESS"] and F.redact(text, alone).startswith("[ADDRESS]")


def test_gates_of_addresses_cover_the_rule():
    assert all(P.GATE.search(t) and P.HOUSE.search(t) for t in ("Birkenweg 5", "5 rue Pasteur", "12bis rue Victor Hugo", "Postfach 7", "C/Mayor, 5"))


# names from public life and from phone books, none from the tables
NAMES = ["Bartholomew Fitzgerald", "Siobhan Gallagher", "Rajesh Kumar", "Agnieszka Kowalska", "Priyanka Chatterjee", "Giovanni Rossi", "Wolfgang Pfeiffer", "Geneviève Beaumont", "Ngozi Okonkwo", "Annegret Steinhauer", "Yevgeny Morozov", "Hiroshi Tanaka", "Cristóbal Echeverría", "Maurizio Ferrante", "Thorbjørn Halvorsen", "Margaret Whitcombe", "Étienne Lefebvre", "Dolores Ibáñez", "Heinrich Obermayer", "Kavita Deshpande"]
AROUND = ["My name is {} and I live here.", "Customer: {}", "Please draft a reply to {}, it is late.", "Kind regards,\n{}\n", "The patient {} left.", "Je m'appelle {}, merci.", "Gestern hat {} die Tür repariert.", "Me llamo {}.", "# author: {}", "Dear {},"]


def test_unseen_names_are_found():
    hit = [any(s.kind == "NAME" and t[s.start : s.end] == n for s in F.spans(t)) for n in NAMES for t in [a.format(n) for a in AROUND]]
    assert sum(hit) >= 0.95 * len(hit)
    assert sum(any(s.kind == "NAME" for s in F.spans(n, True)) for n in NAMES) >= 0.95 * len(NAMES)


@pytest.mark.parametrize("text", ["Customer: Copper Kettle", "Contact New York office", "Ask the Sales Team", "Microsoft Word and Google Chrome are open", "The United States and South Korea signed", "Kontakt\nDiese Seite speichert kleine Dateien", "CON TODO DETALLE Y CON POCO TIEMPO"])
def test_what_is_no_name(text):
    assert F.spans(text) == []
