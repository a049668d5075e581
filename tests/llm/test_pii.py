"""Personal information: mentions of every kind, traps, spans, and replacements."""

import unicodedata

import pytest

from remitloom.llm import pii, surrogates

#: The mentions stand in double brackets; nothing else in a text is one.
TEXTS = [
    ("email", "Reply to ⟦ana.lopez+x@mail.example.org⟧ before 10:20."),
    ("email", "Use ⟦vera26 [at] brisk-post [dot] example⟧; the old mailbox is closed."),
    ("email", "El resumen se envió a ⟦lucia48(at)mene.invalid⟧ y rebotó."),
    ("email", "From: <⟦otis_x @ fujus.test⟧> and ⟦j.doe arroba correo.example⟧."),
    ("email", "RESPONDER A mailto:⟦A.B-C@POSTA.INVALID⟧, GRACIAS"),
    ("email", "cc ⟦joaquin+t AT posta.invalid⟧ and file"),
    ("email", "Write to (⟦ahasksti AT pumin.example⟧) now"),
    (None, "Items priced at 6 @ 790.27 Swiss Franc. Handle @desk2 confirmed, look at this.example"),
    ("phone", "Llamar al ⟦+44 20 7946 0328⟧ después de las 11:21, fax ⟦(912) 555-0194⟧."),
    ("phone", "Dialled ⟦395.555.0178⟧, then ⟦+1-703-555-0123 x16⟧; no reply."),
    ("phone", "Text ⟦0491 570 481⟧ or ⟦07700 900637⟧, ⟦020 7946 0492⟧, ⟦011 0000-8992⟧, ⟦01 99 00 03 52⟧."),
    ("phone", "Client left ⟦00447700900423⟧ and ⟦19245550166⟧; ⟦+55 (00) 90000-4600⟧, ⟦(00) 90000 5282⟧"),
    ("phone", "Tel.: ⟦+44 (0)1632 960796⟧"),
    (None, "In reply to message 12735550180, case 491-76-7702, ticket 59.484.430, ref 628-0316 on 2022-09-16 at 13:22."),
    (None, "mensaje 17135550123; TR-671632, 38.425,69 and 2022/09/01 07:44, lote L85872401"),
    ("identity_number", "Holder quoted SSN ⟦666-59-5195⟧ and passport no. ⟦ZZ-956079⟧ when asked."),
    ("identity_number", "Titular con D.N.I. N° ⟦99.763.826⟧, CUIT ⟦20-99737094-1⟧, NIE ⟦X-0025453-C⟧."),
    ("identity_number", "NI number ⟦QQ 18 28 88 C⟧, tax id ⟦900-25-4117⟧, NIF ⟦000 544 412⟧, bilhete de identidade ⟦0789145 2 ZZ3⟧"),
    ("identity_number", "social security no. ⟦666 93 5457⟧ RG ⟦00.680.457-X⟧"),
    (None, "See the passport office. DNI pending; tax id to follow in 2 days."),
    ("street_address", "Card to be posted to ⟦1011-1013 Cobalt Ave., Apt 53⟧. Registered at ⟦89B Fennel Blvd, 2nd floor⟧; moved to ⟦21 Quarry Bend Terrace⟧."),
    ("street_address", "Domicilio: ⟦Avda. Puente Sordo, 356 dpto. 7⟧. Vive en ⟦C/ los Ceibos Altos nro. 135, piso 7⟧"),
    ("street_address", "Morada: ⟦Rua Doutor Lombardo Sarpe n.º 68⟧, ⟦R. de Pocenal 50, apto 36⟧"),
    ("street_address", "El titular se mudó a ⟦Calle Comandante Varosti N° 79⟧."),
    (None, "Los sueldos de Lantern Marine S.R.L.. Después del Wire, 12 cuentas. The court met on 5 days."),
    ("person_name", "Spoke with Mrs ⟦Wanda Crespquer⟧ about it. Neither ⟦Nuno Garvutegui⟧ nor ⟦Oskelius, Ulises⟧ recall."),
    ("person_name", "Dr. ⟦Vessvane⟧ and ⟦Stellan de Woldvares⟧; ⟦Rakur T. Bracnetti⟧, ⟦Ilse F. Norvimendi⟧, ⟦Priya A.⟧"),
    ("person_name", "Beneficiary ⟦Xunon Norvielius-Ibraxlano⟧ was paid. Según ⟦M. Faeléry⟧, es la devolución."),
    ("person_name", "HABLÉ CON ⟦IÑAKI GARVUREAUX⟧ POR LA REFERENCIA. according to ⟦kate yarroñuela⟧, no."),
    ("person_name", "La firma parece ser de ⟦Agnes Lombalano Varosson⟧. A nombre de ⟦Pilar Müssardo⟧. La de ⟦Zofia van Taviswick⟧. Pago a ⟦Juralorte, Delfina⟧."),
    ("person_name", "Ask for ⟦Tomoko Brandtner⟧ at the counter."),
    (None, "Harrow Dairy GmbH and Kestrel Software LLC pay Juwobefe Banca; According to Pifozu Holding Bank, no."),
]


def split(marked):
    text, spans, start = "", [], None
    for c in marked:
        if c == "⟦":
            start = len(text)
        elif c == "⟧":
            spans.append((start, len(text)))
        else:
            text += c
    return text, spans


@pytest.mark.parametrize(("kind", "marked"), TEXTS)
def test_mentions_and_traps(kind, marked):
    text, spans = split(marked)
    found = [(text[a:b], k) for a, b, k in pii.find_mentions(text)]
    assert found == [(text[a:b], kind) for a, b in spans]


@pytest.mark.parametrize(("kind", "marked"), [t for t in TEXTS if t[0]])
def test_decomposed_letters_keep_their_places(kind, marked):
    text, spans = split(unicodedata.normalize("NFD", marked))
    assert [(a, k) for a, _, k in pii.find_mentions(text)] == [(a, kind) for a, _ in spans]


def test_nothing_in_nothing_and_long_texts():
    assert pii.find_mentions(None) == pii.find_mentions("") == pii.find_mentions(" \n\t") == []
    text = "The desk held back 92 items. " * 20_000 + "Tel.: +44 20 7946 0328"
    assert pii.find_mentions(text) == [(len(text) - 16, len(text), "phone")]
    assert pii.find_mentions("x" * 300_000) == [] and pii.find_mentions("a.b-" * 60_000 + "@") == []
    assert pii.find_mentions("İ İ ana@mail.example")[0][:2] == (4, 20)


@pytest.mark.parametrize("before", ["THE DESK HELD BACK 92 ITEMS. ", "the desk held back 92 items. ", "LOG LINE\n", "ABC ", "abc ", "12 € "])
@pytest.mark.parametrize("times", [0, 20, 2000])
def test_letter_case_is_judged_where_the_name_stands(before, times):
    text, spans = split(before * times + "Ask for ⟦Tomoko Brandtner⟧ at the counter. Neither ⟦Zdenkt Lopez⟧ nor the desk knows.")
    assert [(a, b) for a, b, _ in pii.find_mentions(text)] == spans
    after = text + "\n" + before * times
    assert [(a, b) for a, b, _ in pii.find_mentions(after)] == spans


def test_capitals_tell_nothing_in_a_long_section_of_one_case():
    mixed = "The Desk held back 92 items. " * 300
    assert pii.find_mentions(mixed + "PLEASE ASK FOR PAYMENT TODAY OR TOMORROW; THE FEE OF THE BRANCH STAYS OPEN") == []
    text, spans = split(mixed + "the fee stays open and so on " * 20 + "paid by ⟦rakuro lopez⟧ at the counter")
    assert [(a, b) for a, b, _ in pii.find_mentions(text)] == spans


@pytest.mark.parametrize(
    ("kind", "marked"),
    [
        ("identity_number", "Titular con CURP ⟦GARC850101HDFRRL09⟧, RFC: ⟦GODE561231GR8⟧ y RFC ⟦GODE-561231-GR8⟧."),
        ("identity_number", "driving licence ⟦MORGA657054SM9IJ⟧ was shown, driving licence no. ⟦MORGA 657054 SM9IJ 35⟧ too"),
        ("identity_number", "driver's license ⟦D1234567⟧; RFC ⟦GODE561231⟧ was given"),
        ("street_address", "Lives at ⟦500 Dr Martin Luther King Jr Blvd⟧ now, before at ⟦12 Juan Ponce de la Vega Avenue, Apt 5⟧."),
        ("street_address", "MOVED TO ⟦500 DR MARTIN LUTHER KING JR BLVD⟧"),
        (None, "PAID 500 EURO ACCOUNT STAYS OPEN PLEASE CLOSE. Paid 500 and then the desk went down the street"),
    ],
)
def test_long_identity_numbers_and_streets(kind, marked):
    text, spans = split(marked)
    assert pii.find_mentions(text) == [(a, b, kind) for a, b in spans]


@pytest.mark.parametrize(
    "marked",
    [
        "Mr ⟦Kowalski⟧ said so. The desk told Dra. ⟦Zdenka Horvat⟧ that it holds.",
        "Later ⟦Anna Kowalski⟧ called; ⟦Maria von Stolberg⟧ and ⟦David Szabo-Nagy⟧ did not.",
        "Dear Sir, Please reply. Yes Sir Please reply. Anna May 5; Victoria Station and Grace Bank; Mr Bank",
    ],
)
def test_unlisted_family_names_after_titles_and_given_names(marked):
    text, spans = split(marked)
    assert pii.find_mentions(text) == [(a, b, "person_name") for a, b in spans]


def test_code_points_beyond_the_first_plane():
    assert pii.find_mentions("😀😀 ana@mail.example")[0][0] == 3


def test_entities_are_one_however_written():
    key = surrogates.entity_key
    assert key("email", "Vera26 [at] post [dot] example") == key("email", "vera26@POST.example")
    assert key("person_name", "Oskelius, Ulises") == key("person_name", "ULISES  OSKELIUS")
    assert key("identity_number", "99.763.826") == key("identity_number", "99763826")
    assert key("phone", "+44 20 7946-0328") == key("phone", "00442079460328") == key("phone", "+44 (0)20 79460328")
    assert key("street_address", "89B Fennel Ave., Apt 2") == key("street_address", "89B  FENNEL AVE APT 2")


FORMS = [
    ("phone", "+44 20 7946 0328"),
    ("phone", "+351912345678"),
    ("phone", "(0)20 555-0100 ext. 4"),
    ("identity_number", "QQ 18 28 88 C"),
    ("person_name", "VERA Osk-Lano"),
    ("street_address", "89B Fennel Blvd, 2nd floor"),
    ("email", "vera26 [at] post [dot] example"),
    ("person_name", "Иван Петров"),
    ("person_name", "سليم"),
    ("person_name", "김서연"),
]


@pytest.mark.parametrize(("kind", "value"), FORMS)
def test_form_is_kept(kind, value):
    made = surrogates.replacement(kind, value, "k")
    assert made != value and made == surrogates.replacement(kind, value, "k") != surrogates.replacement(kind, value, "other")
    shape = lambda s: "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "x" if c.isalpha() else c for c in s)
    if kind in ("phone", "identity_number") or not value.isascii():
        assert shape(made) == shape(value)
    if value.startswith("+44"):
        assert made.startswith("+44")
    if kind == "street_address":
        assert "Blvd" in made and "floor" in made
    if kind == "email":
        assert " [at] " in made and made.endswith("[dot] example")
    assert [unicodedata.name(c).split()[0] for c in made if c.isalpha()][:1] == [unicodedata.name(c).split()[0] for c in value if c.isalpha()][:1]


@pytest.mark.parametrize("attempt", [0, 1, 5])
def test_one_entity_has_one_replacement_in_any_spelling(attempt):
    same = [
        ("phone", ["+1 555 123 4567", "+15551234567", "001-555-123-4567", "+1 (555) 123.4567"]),
        ("phone", ["+351 912 345 678", "+351912345678"]),
        ("phone", ["+44 (0)1632 960796", "00441632960796"]),
        ("identity_number", ["20-99737094-1", "20997370941", "20 99737094 1"]),
        ("email", ["ana.b [at] post [dot] example", "ANA.B@POST.EXAMPLE", "ana.b@post.example"]),
        ("street_address", ["89B Fennel Ave., Apt 2", "89b fennel ave apt 2"]),
    ]
    for kind, values in same:
        attempts = {surrogates.entity_key(kind, values[0]): attempt}
        assert len({surrogates.entity_key(kind, surrogates.replacement(kind, v, "k", attempts)) for v in values}) == 1
    attempts = {"garcia": attempt}
    short, long, turned = (surrogates.replacement("person_name", v, "k", attempts) for v in ("García", "Maria García", "GARCIA, MARIA"))
    assert long.endswith(" " + short) and turned.lower() == f"{short}, {long.split()[0]}".lower()


def test_the_whole_key_counts():
    assert surrogates.replacement("phone", "+44 20 7946 0328", "k" * 64 + "a") != surrogates.replacement("phone", "+44 20 7946 0328", "k" * 64 + "b")


def test_given_names_keep_gender_and_stay_apart():
    names = sorted(surrogates._genders())
    made = {n: surrogates.replacement("person_name", n.capitalize(), "k") for n in names if "'" not in n}
    assert len(set(made.values())) == len(made)
    gender = surrogates._genders()
    assert all(gender[surrogates._plain(v)] == gender[n] for n, v in made.items())
    assert surrogates.replacement("person_name", "Zdenka", "k")[-1] == "a"


def test_texts_with_replacements(spark):
    rows = [(1, "Ask for Vera Lopez at the counter. Tel.: +44 20 7946 0328"), (2, "ASK FOR VERA LOPEZ, ana@x.example!"), (3, None), (4, ""), (5, "nothing here"), (6, "Lopez, Vera says ana [at] x [dot] example")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as spans", "'x' as entity", "2 as attempt")
    out = {r["doc_id"]: r for r in surrogates.without_personal_information(docs, "k").collect()}
    assert out[1]["text_placeholders"] == "Ask for [PERSON_NAME] at the counter. Tel.: [PHONE]"
    assert out[2]["text_placeholders"] == "ASK FOR [PERSON_NAME], [EMAIL]!"
    assert (out[3]["text_placeholders"], out[4]["text_placeholders"], out[5]["text_surrogates"]) == (None, "", "nothing here")
    name = out[1]["text_surrogates"][len("Ask for ") :].split(" at the")[0]
    assert name.upper() in out[2]["text_surrogates"] and "Vera" not in name
    redacted = surrogates.without_personal_information(docs, "k")
    assert surrogates.round_trip(docs, redacted, pii.mentions(docs)).count() == 0
    assert surrogates.round_trip(docs, redacted, pii.mentions(docs).filter("span_start > 10")).count() == 3
    assert surrogates.without_personal_information(docs.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        surrogates.without_personal_information(docs, "")


def test_colliding_replacements_are_drawn_again(spark):
    values = [(i, f"DNI 0{i:05}, DNI 0{i:05}") for i in range(300)] + [(None, "DNI 000000")]
    docs = spark.createDataFrame(values, "doc_id bigint, text string")
    found = spark.createDataFrame([("identity_number", [f"{i:02}"]) for i in range(60)] + [("identity_number", ["00"])], "pii_kind string, parts array<string>")
    out = surrogates.surrogate_dictionary(found, "k").collect()
    assert len(out) == 60 and len({r["drawn"] for r in out}) == 60 and any(r["attempt"] for r in out)
    spans = surrogates.replaced_mentions(docs, "k").collect()
    assert len(spans) == 601 and len({r["surrogate"] for r in spans}) == len({(r["value"], r["surrogate"]) for r in spans}) == 300


def test_held_out_names_and_numbers():
    """Recall and precision of at least 0.9 per kind, on sentences written before the rules, with names of no list."""
    import re
    from collections import Counter

    import heldout

    wanted, found, both = Counter(), Counter(), Counter()
    for marked in heldout.MARKED + heldout.PLAIN:
        text, spans, at = "", set(), 0
        for m in re.finditer("⟦(.):(.*?)⟧", marked):
            text += marked[at : m.start()]
            spans.add((len(text), heldout.KINDS[m[1]]))
            text, at = text + m[2], m.end()
        text += marked[at:]
        own = {(a, k) for a, _, k in pii.find_mentions(text)}
        wanted.update(k for _, k in spans)
        found.update(k for _, k in own)
        both.update(k for _, k in spans & own)
    assert all(both[k] >= 0.9 * wanted[k] and both[k] >= 0.9 * found[k] and wanted[k] >= 9 for k in pii.KINDS), (wanted, found, both)
    words = {w for m in heldout.MARKED for x in re.findall("⟦n:(.*?)⟧", m) for w in re.findall(r"[^\W\d_]{3,}", x.lower())}
    lists = pii.L.family_names() | set(pii.L.given_names())
    assert len(words & lists) <= 0.1 * len(words)


def test_frames(spark, rows):
    docs = spark.createDataFrame([(1, "Tel.: +44 20 7946 0328"), (1, "Tel.: +44 20 7946 0328"), (None, "ana@x.example"), (2, None)], "doc_id bigint, text string").selectExpr("*", "'x' as value")
    assert rows(pii.mentions(docs).select("doc_id", "span_start", "pii_kind")) == sorted([(1, 6, "phone"), (1, 6, "phone"), (None, 0, "email")], key=repr)
    assert pii.mentions(docs.limit(0)).count() == 0
