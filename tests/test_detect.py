"""Literal cases of the recognizers, positions and scores included."""

import pytest

from maskline.operators import detect as d

NAMES = ["Lucie", "Émilie", "Marine", "Victoire", "Marc", "Jean-Pierre", "Emmanuelle", "Anaïs", "Nicolas", "Pierre", "Lucas", "Sébastien"]

FOUND = {
    "FR_NIR": [
        ("Sécu de papa : 1 72 06 63 217 045 96 !", ["1 72 06 63 217 045 96"]),
        ("NIR : 291087511230861", ["291087511230861"]),
        ("Carte vitale 1 55 04 2A 004 117 61", ["1 55 04 2A 004 117 61"]),
        ("Carte vitale 2 68 11 2B 033 250 62", ["2 68 11 2B 033 250 62"]),
        ("NIR 1 85 24 97 411 009 29", ["1 85 24 97 411 009 29"]),
        ("NIR 7 01 01 59 350 077 57", ["7 01 01 59 350 077 57"]),
        ("Provisoire 3 92 04 92 050 016 39", ["3 92 04 92 050 016 39"]),
        ("Clé fausse 1 72 06 63 217 045 97.", []),
        ("NIR 5 72 06 63 217 045 96", []),
        ("NIR 1 72 13 63 217 045 96", []),
        ("NIR 1 72 06 63 217 045", []),
        ("Commande 172066321704596123", []),
    ],
    "FR_FISCAL_NUMBER": [
        ("Numéro fiscal : 04 12 345 678 360.", ["04 12 345 678 360"]),
        ("1987654321247", ["1987654321247"]),
        ("27 00 000 001 174", ["27 00 000 001 174"]),
        ("3098765432112 et 0000000511000", ["3098765432112", "0000000511000"]),
        ("Numéro fiscal : 04 12 345 678 361.", []),
        ("44 12 345 678 360", []),
        ("Numéro 04 12 345 678.", []),
        ("Référence 04123456783600", []),
    ],
    "CREDIT_CARD": [
        ("Carte 2221 0000 0012 3454 refusée", ["2221 0000 0012 3454"]),
        ("2720999900001114", ["2720999900001114"]),
        ("CB 2512 3450 0006 7898", ["2512 3450 0006 7898"]),
        ("Visa 4111222233334448", ["4111222233334448"]),
        ("5555-4444-3333-2226", ["5555-4444-3333-2226"]),
        ("Amex 371234567890120", ["371234567890120"]),
        ("2220 9999 0000 1119", []),
        ("2721 9999 0000 1113", []),
        ("Carte 2221 0000 0012 3455", []),
        ("SIRET 361 204 775 00018", []),
    ],
    "IBAN_CODE": [
        ("l'IBAN FR53 2004 1010 0512 3456 7M02 695.", ["FR53 2004 1010 0512 3456 7M02 695"]),
        ("FR2614508000304455667788995 demain", ["FR2614508000304455667788995"]),
        ("DE34370400440987654321", ["DE34370400440987654321"]),
        ("BE83 5100 7547 0351", ["BE83 5100 7547 0351"]),
        ("FR54 2004 1010 0512 3456 7M02 695", []),
        ("IBAN FR53 2004 1010 0512 3456", []),
        ("Avis FR-2023-004455 reçu.", []),
    ],
    "PHONE_NUMBER": [
        *[(f"Rappelez le {n} après midi.", [n]) for n in (
            "06 71 20 39 48", "0671203948", "06.71.20.39.48", "06-71-20-39-48", "07 55 10 98 76", "05 61 33 47 20",
            "+33 6 71 20 39 48", "+33671203948", "+33 (0)5 61 33 47 20", "0033 5 61 33 47 20")],
        ("Facture de 3 480 euros.", []),
        ("Un total de 98 765 432 € cette année", []),
        ("Chrono : 2:04.871 au passage 17", []),
        ("Livraison prévue le 05/11/2025", []),
        ("Exercices 2019 2020 2021 2022", []),
        ("06 71 20 39", []),
    ],
    "FR_ADDRESS": [
        ("Elle est domiciliée 9 rue Marcel Pagnol à Brest.", ["9 rue Marcel Pagnol"]),
        ("Adresse : 31 rue de la Forge, 29200 Brest", ["31 rue de la Forge, 29200 Brest", "29200 Brest"]),
        ("Colis pour le 7 ter avenue du Colonel Fabien 87000 Limoges.", ["7 ter avenue du Colonel Fabien 87000 Limoges", "87000 Limoges"]),
        ("au 62, boulevard Carnot se trouve", ["62, boulevard Carnot"]),
        ("Bureau : 4 allée Georges Brassens 83000 Toulon Cedex 2", ["4 allée Georges Brassens 83000 Toulon Cedex 2", "83000 Toulon Cedex 2"]),
        ("18 sentier Rimbaud\n35400 Saint-Malo\n\nMerci", ["18 sentier Rimbaud\n35400 Saint-Malo", "35400 Saint-Malo"]),
        ("203, quai du Lazaret,\n20200 Bastia", ["203, quai du Lazaret,\n20200 Bastia", "20200 Bastia"]),
        ("Une rue déserte au matin.", []),
        ("On compte 25 rues piétonnes.", []),
        ("Depuis 2019 Nantes a changé.", []),
        ("Prévoir 6 places assises.", []),
    ],
    "URL": [
        ("Réponse à lea.robin@example.org, merci.", []),
        ("Notice : https://example.com/aide?p=2 ou example.net.", ["https://example.com/aide?p=2", "example.net"]),
    ],
    "EMAIL_ADDRESS": [("lea.robin@example.org, x@y.zz9", ["lea.robin@example.org"])],
    "IP_ADDRESS": [("de 192.168.1.1 à 999.1.1.1, ::1 ou fe80::1:2", ["192.168.1.1", "::1", "fe80::1:2"])],
    "CRYPTO": [
        ("vers 1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2", ["1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2"]),
        ("vers bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", ["bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"]),
        ("vers 1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN3 ou bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5", []),
    ],
    "DATE_TIME": [("le 12/03/2024 et le 2024-03-12, version 1.2.3.4", ["12/03/2024", "2024-03-12"])],
}


def found(spark, texts, lang="fr", entities=None):
    docs = spark.createDataFrame([(i, lang, x) for i, x in enumerate(texts)], "doc_id long, lang string, text string")
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    rows = d.detect_all(docs, names, entities).collect()
    for r in rows:
        assert texts[r.doc_id][r.start : r.end] == r.value
    return sorted(rows, key=lambda r: (r.doc_id, r.start, -r.end))


@pytest.mark.parametrize("entity", sorted(FOUND))
def test_values(spark, entity):
    cases = FOUND[entity]
    rows = found(spark, [text for text, _ in cases], entities=[entity])
    for i, (text, expected) in enumerate(cases):
        assert [r.value for r in rows if r.doc_id == i] == expected, text


PEOPLE = [
    ("Lucie Garnier\n5, avenue Foch, 29200 Brest", "Lucie Garnier", 0.85),
    ("Cordialement,\nÉmilie Texier", "Émilie Texier", 1.0),
    ("Bien à vous,\nMarine", "Marine", 1.0),
    ("M. Lucas Hamelin\n9, rue Carnot", "Lucas Hamelin", 0.85),
    ("Mme Victoire Lanoë", "Victoire Lanoë", 0.85),
    ("Bonjour Docteur Bazin,", "Bazin", 1.0),
    ("Nom : Carpentier\nPrénom : Sébastien", "Carpentier", 0.85),
    # "ami" is a substring of "famille": context words match so.
    ("Nom de famille : Carpentier", "Carpentier", 1.0),
    ("La voisine, Victoire Leduc, est là.", "Victoire Leduc", 0.6),
    ("Je soussigné(e) Marc Olivet, vivant au 3 rue Carnot", "Marc Olivet", 0.95),
    ("La copie de Jean-Pierre Dos Reis est rendue.", "Jean-Pierre Dos Reis", 0.6),
    ("La trésorière, Emmanuelle de la Rivière, a écrit.", "Emmanuelle de la Rivière", 0.6),
    ("Salut Anaïs, on y va.", "Anaïs", 0.65),
    ("Je viens avec mon fils Nicolas samedi.", "Nicolas", 0.65),
    ("Pierre ponce et sable.", "Pierre", 0.3),
]
NOBODY = ["Garage Beau Rivage\nSIRET 361 204 775 00018", "Madame, Monsieur,", "Monsieur le Maire,", "BULLETIN D'INSCRIPTION", "Objet : facture en retard"]


def test_people(spark):
    rows = found(spark, [t for t, *_ in PEOPLE] + NOBODY, entities=["PERSON"])
    for i, (text, name, score) in enumerate(PEOPLE):
        assert {r.value: r.score for r in rows if r.doc_id == i}.get(name) == pytest.approx(score), text
    assert [r.value for r in rows if r.doc_id >= len(PEOPLE)] == []


def test_a_letter_as_published(spark):
    """Types, scores and context words of one letter."""
    text = (
        "Marc Vallier\n3 impasse des Genêts\n35000 Rennes\n\nBonsoir,\n\nSécurité sociale de papa : "
        "1 72 06 63 217 045 96. Avis fiscal 04 12 345 678 360.\n\nVersement sur mon compte "
        "FR53 2004 1010 0512 3456 7M02 695 ou sa carte 2221 0000 0012 3454.\n\nPour me joindre : 06 71 20 39 48."
    )
    rows = {(r.entity_type, r.value): (r.score, r.context_word, r.checksum) for r in found(spark, [text])}
    assert rows[("PERSON", "Marc Vallier")] == (0.85, None, None)
    assert rows[("FR_ADDRESS", "3 impasse des Genêts\n35000 Rennes")] == (0.6, None, None)
    assert rows[("FR_NIR", "1 72 06 63 217 045 96")] == (1.0, "sécurité", True)
    assert rows[("FR_FISCAL_NUMBER", "04 12 345 678 360")] == (1.0, "fiscal", True)
    assert rows[("IBAN_CODE", "FR53 2004 1010 0512 3456 7M02 695")] == (1.0, "compte", True)
    assert rows[("CREDIT_CARD", "2221 0000 0012 3454")] == (1.0, "carte", True)
    assert rows[("PHONE_NUMBER", "06 71 20 39 48")] == (0.75, "joindre", None)


def test_positions_count_code_points_and_survive_control_characters(spark):
    text = "😀 é \u0001x\u0002 06 71 20 39 48 😀 a@example.fr"
    values = [r.value for r in found(spark, [text])]
    assert values == ["06 71 20 39 48", "a@example.fr"]


def test_an_endless_run_of_capitalized_words(spark):
    text = "Marc " + " ".join(["Martin"] * 20000) + " 12 rue " + "Alpha " * 20000
    rows = found(spark, [text], entities=["PERSON", "FR_ADDRESS"])
    assert {r.entity_type for r in rows} == {"PERSON", "FR_ADDRESS"}


def test_other_languages_have_no_recognizer(spark):
    assert found(spark, ["a@example.fr"], lang="de") == []


def test_french_phone_in_english_text(spark):
    assert [r.value for r in found(spark, ["Ring me at +33 6 71 20 39 48 now"], lang="en", entities=["PHONE_NUMBER"])][:1] == ["+33 6 71 20 39 48"]


def test_detection_is_one_narrow_stage(spark):
    docs = spark.createDataFrame([(1, "fr", "x")], "doc_id long, lang string, text string")
    plan = d.detect(docs, d.PATTERN_RECOGNIZERS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


ENDLESS = 100_000


@pytest.mark.parametrize(
    "text",
    [
        "44000 " + "Paris " * ENDLESS, "12 rue " + "Saint " * ENDLESS + "44000 " + "Nantes-" * ENDLESS, "x@" + "a." * ENDLESS + "com",
        "x@" + "a." * ENDLESS, "https://" + "a." * ENDLESS + "com", "a." * ENDLESS + "com", "x" * ENDLESS + "@" + "a" * ENDLESS + ".fr",
        "1 " * ENDLESS, "1." * ENDLESS, "12:" * ENDLESS, ":" * ENDLESS, "0612345678 " * ENDLESS, "+33 6 " * ENDLESS, "FR76 " * ENDLESS,
        "4111-1111-" * ENDLESS, "bc1" + "q" * ENDLESS, "Jean " * ENDLESS, "Jean-" * ENDLESS, "Jean de la " * ENDLESS,
    ],
    ids=lambda t: t[:12],
)
def test_no_text_ends_the_job(spark, text):
    docs = spark.createDataFrame([(0, "fr", text), (1, "en", text)], "doc_id bigint, lang string, text string")
    names = spark.createDataFrame([("Jean",)], "name string")
    assert d.detect_all(docs, names).agg({"end": "max"}).first() is not None


def test_emails_at_any_domain(spark):
    text = "jo@site.ai, jo@x.museum. a@b.c.fr a@b.com.123 a@7seas.com a@b.com.X jo@localhost"
    docs = spark.createDataFrame([(0, "fr", text)], "doc_id bigint, lang string, text string")
    got = {(r["value"], r["score"], r["checksum"]) for r in d.detect_email(docs).collect()}
    assert got == {
        ("jo@site.ai", 0.5, None), ("jo@x.museum", 0.5, None), ("a@b.c.fr", 1.0, True), ("a@b.com", 1.0, True), ("a@7seas.com", 1.0, True),
    }


def test_ipv6_needs_a_group(spark):
    docs = spark.createDataFrame([(0, "en", "main :: IO Int, ::1, fe80::1 and :: or :::")], "doc_id bigint, lang string, text string")
    assert {r["value"] for r in d.detect_ip(docs).collect()} == {"::1", "fe80::1"}


def test_languages_without_recognizer_are_not_read(spark, tmp_path):
    spark.createDataFrame([(0, "en", "+1 415 555 2671")], "doc_id bigint, lang string, text string").write.parquet(str(tmp_path / "t"))
    plan = d.detect_intl_phone(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().toString()
    assert "EqualTo(lang,en)" in plan
