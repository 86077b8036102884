"""p8: spans by kind, decoys, validators and replacement."""

import pytest

from lexigrid.llm.personal import cpf_ok, dni_ok, find_spans, luhn, mod97, personal_spans, redact, redacted

CASES = [
    ("Send it to a.b+sql@mail.example.test.", [("email", "a.b+sql@mail.example.test")]),
    ("e-mail: lee79 @ nord.example –", [("email", "lee79 @ nord.example")]),
    ("(lee (at) nord (dot) example)", [("email", "lee (at) nord (dot) example")]),
    ("mailto:LEE[at]NORD.EXAMPLE;", [("email", "LEE[at]NORD.EXAMPLE")]),
    ("telefone +44 7700 900463, ramal 4", [("phone", "+44 7700 900463")]),
    ("mob (312) 555-0163 / desk line", [("phone", "(312) 555-0163")]),
    ("Rückruf unter 030/23125-059.", [("phone", "030/23125-059")]),
    ("'312.555.0152' AS contact_phone", [("phone", "312.555.0152")]),
    ("SSN: 666 59 2197 was", [("id_number", "666 59 2197")]),
    ("National Insurance no. QQ 20 27 19 B.", [("id_number", "QQ 20 27 19 B")]),
    ("cadastro com CPF nº 151.810.376-81", [("id_number", "151.810.376-81")]),
    ("documento de identidad 95330473-X", [("id_number", "95330473-X")]),
    ("lives at 150B Lantern Rd since May", [("address", "150B Lantern Rd")]),
    ("Ship to 14 Quiet Otter Street, Dunmarrow", [("address", "14 Quiet Otter Street")]),
    ("mora na Rua da Lanterna Azul, nº 6 desde maio", [("address", "Rua da Lanterna Azul, nº 6")]),
    ("Dirección: C/ de las Tres Garzas n.º 152.", [("address", "C/ de las Tres Garzas n.º 152")]),
    ("wohnt Laternengasse 101b;", [("address", "Laternengasse 101b")]),
    ("Ask Dr. Ruth Pellham before", [("name", "Ruth Pellham")]),
    ("Dear Wendfold, Clara, the file is back.", [("name", "Wendfold, Clara")]),
    ("WHERE full_name = 'Helen Haskmore-Tarn'", [("name", "Helen Haskmore-Tarn")]),
    ("Reported by G. Brumholm yesterday.", [("name", "G. Brumholm")]),
    ("Viele Grüße\nJürgen Ormlund –", [("name", "Jürgen Ormlund")]),
    ("owner: GEORGE ORMSTEAD.", [("name", "GEORGE ORMSTEAD")]),
    ("Hablé con Inés da Haskstead del cierre", [("name", "Inés da Haskstead")]),
]
DECOYS = [
    "The Granite Harbor Ledger is due at 12:30.", "Street and city columns come from the Address Book Import.", "Order 4012-889-3312 stays open.", "Build 10.2.45.118 of the viewer fixed it.",
    "Row 00012345678 is the sentinel.", "Sum was 1.234.567,89 before rounding.", "Column owner_email is masked as <name>@<domain>.", "Parameter @start_day defaults to 2023-01-31 00:00:00.",
    "SELECT Top (100) a.x From dbo.Order_Line As a Inner Join Kiln As b On a.id = 123456789", "Contact: reporting desk, second floor.", "hash 9f86d081884c7d659a2feaa0c55ad015", "phone_no and tax_no are text columns of length 20.", "", None,
]


@pytest.mark.parametrize("text, spans", CASES)
def test_found(text, spans):
    assert [(k, text[a:b]) for a, b, k in find_spans(text)] == spans


@pytest.mark.parametrize("text", DECOYS)
def test_decoys(text):
    assert find_spans(text) == [] and redact(text) == text


def test_validators():
    assert cpf_ok("529.982.247-25") and not cpf_ok("529.982.247-26") and not cpf_ok("111.111.111-11")
    assert dni_ok("12345678Z") and not dni_ok("12345678A") and dni_ok("X1234567L")
    assert luhn("4539 1488 0343 6467") and not luhn("4539 1488 0343 6468")
    assert mod97("85.07.30-033.28") and not mod97("85.07.30-033.29") and mod97("2 55 08 14 168 025 38") and not mod97("2 55 08 14 168 025 39")


# Numbers that stand without a label; the check digit alone decides.
UNLABELLED = ["811218-9876", "19811218-9876", "800101 5009 087", "8001015009087", "85.07.30-033.28", "2 55 08 14 168 025 38", "255081416802538", "529.982.247-25", "12345678Z"]


@pytest.mark.parametrize("number", UNLABELLED)
def test_check_digits_decide(number):
    text = "the sheet says %s in its last line"
    assert [(k, number) for _, _, k in find_spans(text % number)] == [("id_number", number)]
    last = number[-1]
    other = chr(ord(last) + 1) if last not in "9Z" else {"9": "8", "Z": "A"}[last]
    assert find_spans(text % (number[:-1] + other)) == []
    # a label is enough
    assert [k for _, _, k in find_spans(f"passport number {number[:-1] + other} in it")] == ["id_number"]


def test_number_with_letters_in_between():
    text = "passport no. X4F7G9H2K of the tenant"
    assert [text[a:b] for a, b, _ in find_spans(text)] == ["X4F7G9H2K"]


@pytest.mark.parametrize("name", ["Maria Clara Helena Souza Lima", "Zbigniew Jan Pawel Adam Kowalczyk", "Juan Carlos de la Cruz Romero Ortega"])
def test_long_names_are_whole(name):
    assert [f"Reported by {name} today."[a:b] for a, b, _ in find_spans(f"Reported by {name} today.")] == [name]


def test_redact_keeps_the_rest():
    text = "Ask Dr. Ruth Pellham, mail r.p@x.example or call +44 7700 900463."
    assert redact(text) == "Ask Dr. [NAME], mail [EMAIL] or call [PHONE]."


def test_table(spark):
    rows = [(1, "call +44 7700 900463, +44 7700 900463 again"), (2, None), (3, ""), (4, "x " * 50000 + "SSN 666-33-1835")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in personal_spans(df).collect()} == {(1, "phone", "+44 7700 900463"), (4, "id_number", "666-33-1835")}
    got = {r[0]: r[1] for r in df.select("doc_id", redacted(df["text"])).collect()}
    assert got[2] is None and got[3] == "" and got[1] == "call [PHONE], [PHONE] again" and got[4].endswith("[ID_NUMBER]")
    assert personal_spans(df.limit(0)).count() == 0
