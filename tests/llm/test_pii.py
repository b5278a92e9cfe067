import math

import pytest

from skald.llm import pii_rules as rules
from skald.llm.pii import find_details, fixed_details, learn_names, redact

NAMES = [("Orrin", "given"), ("Tamsel", "given"), ("Velkomir", "family"), ("Karvostad", "family"), (None, "given"), ("Orrin", "given")]


@pytest.mark.parametrize(
    "text,kind,values",
    [
        ("cc orrin+shard@eu.fennel.test; thanks", "email", ["orrin+shard@eu.fennel.test"]),
        ("<A-B@Example.COM> only", "email", ["A-B@Example.COM"]),
        ("reach me at a.b [at] eu [dot] fennel [dot] test please", "email", ["a.b [at] eu [dot] fennel [dot] test"]),
        ("to x_y (at) post.tarn.invalid.", "email", ["x_y (at) post.tarn.invalid"]),
        ("contact:a AT example DOT net", "email", ["a AT example DOT net"]),
        ("Pinned left-merge@5.6.8 for now. @retry(times=3)", "email", []),
        ("look at example.org at noon", "email", []),
        ("Call +44 (0)20 7946 0416 if", "phone", ["+44 (0)20 7946 0416"]),
        ("tel: (415) 555-0137, 202.555.0157 ext. 12", "phone", ["(415) 555-0137", "202.555.0157 ext. 12"]),
        ("0049 30 23125831 or 020 7946 0508 or +17065550151 or 1-312-555-0133 or (02) 5550 8355 or +49 30 23125-124.", "phone", ["0049 30 23125831", "020 7946 0508", "+17065550151", "1-312-555-0133", "(02) 5550 8355", "+49 30 23125-124"]),
        ("Batch 2026-12-17-6003; Epoch 1767451498; Node 192.0.2.146; Build 10.43.681-9306; INC-1615-617; 974-801 of 4228", "phone", []),
        ("SSN 966-47-1621, ssn on file: 937446069", "id_number", ["966-47-1621", "937446069"]),
        ("NI no. QQ 19 21 83 C. tax id 01 485 221 388; DNI 00033270-Y", "id_number", ["QQ 19 21 83 C", "01 485 221 388", "00033270-Y"]),
        ("my identity card says 00022729G; passport no. Z04994087; driver's licence K538-4305-8033", "id_number", ["00022729G", "Z04994087", "K538-4305-8033"]),
        ("shard 00085776 moved; Offset 991843726", "id_number", []),
        ("I work from 360 Orchard Lane (Town)", "address", ["360 Orchard Lane"]),
        ("to 57 Heron Blvd, Suite 40B, 34389 Quenby; 279 copperfield rd", "address", ["57 Heron Blvd, Suite 40B", "279 copperfield rd"]),
        ("C/ Faro 30, Lindengasse 199b, Mühlenstr. 362b, 263 avenue des Tilleuls, Avenida del Molino 53", "address", ["C/ Faro 30", "Lindengasse 199b", "Mühlenstr. 362b", "263 avenue des Tilleuls", "Avenida del Molino 53"]),
        ("With 866 router rows; 2 brittle Lane 16 of Juniperfs; 3 dense Dr. Who", "address", []),
    ],
)
def test_forms(text, kind, values):
    found = [text[a:b] for a, b, k in fixed_details(text) if k == kind]
    assert sorted(found) == sorted(values)


def test_forms_on_long_texts():
    for t in ("a" * 200_000, "a." * 100_000, "1-" * 100_000, "Aa " * 60_000, "12 " * 60_000, "x at y dot " * 20_000):
        fixed_details(t)
    assert rules.emails("") == []


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "seq bigint, content string, kind int, value string")


TEXTS = (
    ["As Orrin Velkomir said", "Dr. Velkomir, Tamsel J. signed", "ask T. Velkomir now", "TAMSEL KARVOSTAD owns", "tamsel k. velkomir owns"]
    + ["Node Orrin restarted 5 times", "The Velkomir shard", "x orrin.velkomir@example.org y"]
    + ["As Orrin Sundhuist said", "Please ask Sundhuist, Tamsel today", "by R. Sundhuist", "RUVIM VELKOMIR owns it", "Ruvim Sundhuist came", "thanks ruvim sundhuist"]
    + ["Bitte Velkomir, Orrin fragen"] + ["Bitte warten"] * 30 + ["The end"] * 30
    + [None, "", " ", "As Orrin Velkomir said", "z" * 100_000]
)
EXPECTED = {
    0: {"Orrin Velkomir"}, 1: {"Velkomir, Tamsel J."}, 2: {"T. Velkomir"}, 3: {"TAMSEL KARVOSTAD"}, 4: {"tamsel k. velkomir"}, 8: {"Orrin Sundhuist"}, 9: {"Sundhuist, Tamsel"},
    10: {"R. Sundhuist"}, 11: {"RUVIM VELKOMIR"}, 12: {"Ruvim Sundhuist"}, 13: {"ruvim sundhuist"}, 14: {"Velkomir, Orrin"}, len(TEXTS) - 2: {"Orrin Velkomir"},
}


def persons(rows):
    out = {}
    for r in rows:
        if r.kind == "person":
            out.setdefault(r.seq, set()).add(r.value)
    return out


def test_persons_learn_from_the_corpus(spark):
    df, names = frame(spark, TEXTS), spark.createDataFrame(NAMES, "name string, name_part string")
    learned = {(r.term, r.part) for r in learn_names(df, names).filter("bits is not null").collect()}
    assert {("sundhuist", "family"), ("ruvim", "given")} <= learned and not {t for t, _ in learned} & {"bitte", "the", "restarted", "node"}
    assert persons(find_details(df, names).collect()) == EXPECTED
    # the way beyond the broadcast limit
    assert persons(find_details(df, names, max_terms=1).collect()) == EXPECTED


def test_names_at_the_end_of_a_chain(spark):
    df, names = frame(spark, ["Orrin Fama", "Gamo Fama", "Gamo Fbeta", "Gdelta Fbeta", "Gdelta Fepsi", "Gzeta Fepsi"]), spark.createDataFrame(NAMES, "name string, name_part string")
    learned = {(r.term, r.part) for r in learn_names(df, names).collect()}
    assert {("fbeta", "family"), ("gdelta", "given"), ("fepsi", "family"), ("gzeta", "given")} <= learned


def test_a_long_list_learns_the_same(spark):
    df, names = frame(spark, ["As Orrin Sundhuist said"] * 3 + ["wobei sundhuist kam", "thanks tamsel sundhuist"]), spark.createDataFrame(NAMES, "name string, name_part string")
    few, many = (sorted(map(tuple, learn_names(df, names, max_terms=n).collect())) for n in (100, 1))
    assert ("sundhuist", "family") in {x[:2] for x in few} and "wobei" not in {x[0] for x in few} and many == few


def test_redaction_and_empty_tables(spark):
    df = frame(spark, ["😀 Orrin Velkomir, call 020 7946 0508; orrin@example.org!", "nothing here", None])
    names = spark.createDataFrame(NAMES, "name string, name_part string")
    out = {r.seq: r.content for r in redact(df, names).collect()}
    assert out == {0: "😀 [PERSON], call [PHONE]; [EMAIL]!", 1: "nothing here", 2: None}
    assert find_details(df.limit(0), names).count() == 0
    assert persons(find_details(df, names.limit(0)).collect()) == {}


def test_information_of_a_term(spark):
    texts = ["Orrin Velkomir left"] * 8 + ["Orrin Sundhuist left"] * 2 + ["Orrin Report is late"] * 2 + ["The report, a report, or Report came"] * 40
    df, names = frame(spark, texts), spark.createDataFrame(NAMES, "name string, name_part string")
    known = {(r.term, r.part): r for r in learn_names(df, names).collect()}
    assert ("report", "family") not in known and ("sundhuist", "family") in known
    total = 8 * 3 + 2 * 3 + 2 * 4 + 40 * 7
    assert abs(known["sundhuist", "family"].bits - math.log2(total / 16)) < 1e-9 and known["sundhuist", "family"].left == 0


def test_generalised_names(spark):
    df = frame(spark, ["Orrin Velkomir met Tamsel at orrin@example.org", "ask Velkomir, orrin", "ORRIN"])
    names = spark.createDataFrame(NAMES, "name string, name_part string")
    out = {r.seq: r.content for r in redact(df, names, generalise=True).collect()}
    assert out == {0: "[PERSON] met [NAME] at [EMAIL]", 1: "ask [PERSON]", 2: "[NAME]"}
    assert redact(df, names).filter("content = 'ORRIN'").count() == 1
