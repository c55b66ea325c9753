import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import pii

KEY = b"a key of the tests"


def test_detection():
    text = 'Mail a.b+c@mail3.example.com, call +1 (017) 555-7713 or 555-123-4567; card 4111 1111 1111 1111, ip 10.0.0.255. SSN 123-45-6789; token = "abcdef0123456789"; Mrs. Anna Smith and Dr Łukasz; GB29 NWBK 6016 1331 9268 19; ' + "a1" * 20 + "."
    got = [(k, text[a:b]) for a, b, k in pii.detect(text)]
    assert got == [
        ("email", "a.b+c@mail3.example.com"), ("phone", "+1 (017) 555-7713"), ("phone", "555-123-4567"), ("card", "4111 1111 1111 1111"), ("ip", "10.0.0.255"),
        ("ssn", "123-45-6789"), ("secret", "abcdef0123456789"), ("name_f", "Anna Smith"), ("name", "Łukasz"), ("iban", "GB29 NWBK 6016 1331 9268 19"), ("hex", "a1" * 20),
    ]
    for clean in ("In 2024 we had 12 500 items, 3.14 and 1,000,000.", "version 1.2.3.4.5", "The Mr nobody", "a = b", "12-34-56"):
        assert not pii.detect(clean), clean


def pattern(s):
    return re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "9", s)))


def test_form_gender_and_parts_are_kept():
    s = lambda kind, x: pii.surrogate(kind, x, KEY)
    assert pattern(s("email", "the.72@mail3.example.com")) == "aaa.99@aaaa9.aaaaaaa.aaa" and s("email", "the.72@mail3.example.com").endswith(".com")
    assert s("email", "x@corp.org").split("@")[1] == s("email", "y@corp.org").split("@")[1]
    card = s("card", "4111 1111 1111 1111")
    digits = card.replace(" ", "")
    assert pattern(card) == "9999 9999 9999 9999" and pii._luhn(digits[:-1]) == int(digits[-1])
    assert all(int(x) < 256 for x in s("ip", "10.0.0.255").split("."))
    first, last = s("name_f", "Anna Smith").split(" ")
    assert first in pii.FEMALE and first != "Anna" and last == s("name", "Smith") and pattern(last) == "Aaaaa"
    assert s("name_m", "John Smith").split(" ")[0] in pii.MALE
    assert re.fullmatch(r"[А-Я][а-я]{4}", s("name", "Петро"))
    assert pii.surrogate("card", "4111111111111111", b"other") != s("card", "4111111111111111")


@settings(max_examples=100, deadline=None)
@given(st.sampled_from([("phone", 3, "0123456789"), ("email", 2, "ab"), ("name", 2, "Ab"), ("hex", 3, "0123456789abcdef")]))
def test_permutations_are_one_to_one(case):
    kind, n, letters = case
    import itertools

    words = ["".join(w) for w in itertools.product(letters, repeat=n)]
    if kind == "email":
        words = [w + "@x.com" for w in words]
    if kind == "hex":
        words = [w for w in words if w == w.lower()]
    assert len({pii.surrogate(kind, w, KEY) for w in words}) == len(words)


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    real, back, seen = set(), {}, 0
    for r in pii.op4_pii_surrogates(spark, sf).collect():
        found = pii.detect(docs[r.doc_id])
        assert r.n_entities == len(found) == len(r.spans)
        if not found:
            assert r.text == docs[r.doc_id]
        for (a, b, kind), s in zip(found, r.spans):
            entity, new = docs[r.doc_id][a:b], r.text[s.start : s.end]
            real.add(entity)
            assert len(entity) == len(new) or kind == "ip"
            assert back.setdefault((kind, new), entity) == entity
            seen += 1
    assert seen > 5 and not real & {new for _, new in back}


def test_collisions_walk_on(spark, make_docs):
    """A corpus that holds the surrogates of its own entities: none may stay, all stay distinct; both ways of applying agree."""
    rnd = random.Random(2)
    ips = [f"{rnd.randrange(256)}.{rnd.randrange(256)}.1.{k}" for k in range(20)]
    ips += [pii.surrogate("ip", x, KEY) for x in ips] + [pii.surrogate("ip", pii.surrogate("ip", ips[0], KEY), KEY)]
    texts = [f"from {x} to {ips[0]} end" for x in ips] + [None, "", "clean"] + ["+1 " + "5" * 3 + "-123-4567 twice +1 555-123-4567"]
    docs = make_docs(texts).withColumn("kind", F.lit("k")).withColumn("entity", F.lit(1))
    got = {r.doc_id: r for r in pii.with_surrogates(docs, KEY).collect()}
    other = {r.doc_id: r for r in pii.with_surrogates(docs, KEY, exception_rows=0).collect()}
    assert {k: (v.text, v.pii_n) for k, v in got.items()} == {k: (v.text, v.pii_n) for k, v in other.items()}
    new = {}
    for i, x in enumerate(ips):
        words = got[i].text.split(" ")
        new[x] = words[1]
        assert words[3] == got[0].text.split(" ")[1]
    assert len(set(new.values())) == len(set(ips)) and not set(new.values()) & set(ips)
    assert got[len(ips)].text is None and got[len(ips) + 1].text == "" and got[len(ips) + 2].text == "clean"
    words = got[len(ips) + 3].text.split(" ")
    assert words[1] == words[4] and pii.with_surrogates(docs.limit(0), KEY).count() == 0
    assert pii.with_surrogates(docs.union(docs), KEY).count() == 2 * len(texts)


def named(texts, rows):
    """Name -> replacement of rows 'by Dr NAME end'."""
    return {t.split(" ")[2]: r.text.split(" ")[2] for t, r in zip(texts, sorted(rows, key=lambda r: r.doc_id))}


def test_names_of_other_scripts_are_replaced(spark, make_docs):
    names = ["محمد", "דוד", "अमित", "Ўткир", "ไพลิน", "José", "Żółć"]
    texts = [f"by Dr {x} end" for x in names]
    got = named(texts, pii.with_surrogates(make_docs(texts), KEY).collect())
    for old, new in got.items():
        assert len(new) == len(old) and new != old
        for a, b in zip(old, new):
            assert (ord(a) >> 8 == ord(b) >> 8 or a < "\u0180") and (a != b or not a.isalpha() or sum(x != y for x, y in zip(old, new)) > 1), (old, new)
    assert len(set(got.values())) == len(names)


def test_full_formats_are_left_by_drawn_replacements(spark, make_docs, monkeypatch):
    """All 676 two-letter surnames, and a secret without letters: no free value of their formats is left."""
    monkeypatch.setattr(pii, "MAX_TRIES", 3)
    names = [a + b for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "abcdefghijklmnopqrstuvwxyz"]
    texts = [f"by Dr {x} end" for x in names]
    rows = pii.with_surrogates(make_docs([*texts, 'token = "$$$$$$$$"']), KEY).collect()
    got = named(texts, [r for r in rows if r.doc_id < len(texts)])
    assert len(set(got.values())) == len(names) and not set(got.values()) & set(names)
    assert all(re.fullmatch("[A-Z][a-z]+", new) for new in got.values()) and sum(new.startswith(old) for old, new in got.items()) < 10
    assert re.search('"[a-z]{16,}"', next(r.text for r in rows if r.doc_id == len(texts)))


def test_drawn_replacements_keep_the_format():
    for kind, x in [("card", "4111 1111 1111 1111"), ("ssn", "123-45-6789"), ("phone", "+1 (017) 555-7713"), ("ip", "10.0.0.255"), ("iban", "GB29 NWBK 6016 1331 9268 19"), ("hex", "a1" * 20), ("domain", "corp"), ("surname", "Li"), ("surname", "דוד")]:
        new = {pii.drawn(kind, x, k, KEY) for k in range(pii.SAME_LENGTH_DRAWS)}
        text = [{"surname": f"Dr {n} ", "domain": f"a@{n}.com"}.get(kind, f" {n} ") for n in new]
        assert len(new) == pii.SAME_LENGTH_DRAWS and x not in new
        assert [[k for _, _, k in pii.detect(t)] for t in text] == [[{"surname": "name", "domain": "email"}.get(kind, kind)]] * len(text)
        if kind == "card":
            assert all(pii._luhn(n.replace(" ", "")[:-1]) == int(n[-1]) for n in new)
    assert len(pii.drawn("ssn", "123-45-6789", pii.SAME_LENGTH_DRAWS + 2, KEY)) == 13


def valid_iban(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def test_ibans_keep_country_and_validity():
    for x, ok in [("GB29 NWBK 6016 1331 9268 19", True), ("DE89370400440532013000", True), ("DE88370400440532013000", False), ("FR76 3000 6000 0112 3456 7890 189", True)]:
        new = pii.surrogate("iban", x, KEY)
        assert new[:2] == x[:2] and new != x and len(new) == len(x) and valid_iban(new) == valid_iban(x) == ok
        assert [c == " " for c in new] == [c == " " for c in x]


def test_names_without_a_title_and_their_endings():
    text = "We met Anna Schmidt and Xenia Kowalska; Mrs Xenia Petrov came."
    assert [text[a:b] for a, b, _ in pii.detect(text)] == ["Anna Schmidt", "Xenia Petrov"]
    new = pii.surrogate("name_f", "Xenia Petrov", KEY)
    assert new.split(" ")[0].endswith("a") and new.split(" ")[1] != "Petrov"


def test_parts_stay_together_when_they_collide(spark, make_docs):
    """Surnames and domains whose surrogates are real: moved in every name and address alike."""
    taken, host = pii.part_surrogate("surname", "Smith", KEY), pii.part_surrogate("domain", "corp", KEY)
    texts = ["by Dr Smith end", "by Mr John Smith end", f"by Dr {taken} end", "to x@corp.com end", "to y@corp.com end", f"to z@{host}.org end"]
    rows = {r.doc_id: r.text for r in pii.with_surrogates(make_docs(texts), KEY).collect()}
    smith = rows[0].split(" ")[2]
    assert smith not in ("Smith", taken) and rows[1].split(" ")[3] == smith
    domain = rows[3].split("@")[1].split(".")[0]
    assert domain not in ("corp", host) and rows[4].split("@")[1].startswith(f"{domain}.com")
    assert rows[5].split("@")[1].split(".")[0] not in ("corp", host, domain)


def plain_rule(docs):
    """The rule in words, over dictionaries: finds by plain means, walks one after another in order."""
    real = {x for t in docs for a, b, k in pii.detect(t or "") for x in pii.parts_of(k, (t or "")[a:b])}
    checked = sorted(x for x in real if x[0] not in ("first", "local"))
    first = {x: pii.part_surrogate(*x, KEY) for x in checked}
    hit = [x for x in checked if (x[0], first[x]) in real]
    return first, hit


def test_brute_force_on_scripts_and_forms(spark, make_docs):
    """No original part survives; parts, scripts and forms agree in all documents; nothing else changes."""
    rnd = random.Random(3)
    names = ["Łukasz Šimek", "محمد علي", "अमित शर्मा", "Anna Schmidt", "José Núñez", "Ωμέγα Άλφα", "Żółć"]
    forms = ["{}@corp{}.com", "10.{}.7.{}", "555-{:03d}-{:04d}"]
    texts = []
    for i in range(120):
        name = rnd.choice(names)
        x, y = rnd.randrange(250), rnd.randrange(250)
        texts.append(f"§{i} Dr {name} wrote {rnd.choice(forms).format(x, y)} and left, " + "plain text " * rnd.randrange(3))
    texts += ["plain " * 200_000 + "Dr Smith", None, "", texts[0]]
    rows = {r.doc_id: r for r in pii.with_surrogates(make_docs(texts).withColumn("pii_n", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("row_key", F.lit(1)), KEY).collect()}
    image = {}
    first, hit = plain_rule(texts)
    for i, t in enumerate(texts):
        r, at = rows[i], 0
        found = pii.detect(t or "")
        assert r.pii_n == len(found) == len(r.pii_spans)
        rest = []
        for (a, b, kind), s in zip(found, r.pii_spans):
            rest.append((t[at:a], r.text[(r.pii_spans[len(rest) - 1].end if rest else 0) : s.start]))
            at = b
            for old, new in zip(pii.parts_of(kind, t[a:b]), pii.parts_of(kind, r.text[s.start : s.end])):
                assert image.setdefault(old, new) == new and old != new
                if old in first and old not in hit:
                    assert new[1] == first[old]
        assert all(x == y for x, y in rest) and (t or "")[at:] == (r.text or "")[r.pii_spans[-1].end if found else 0 :]
    assert len(set(image.values())) == len(image) and not {x for x in image.values() if x[0] not in ("first", "local")} & set(image)
    for (_, old), (_, new) in image.items():
        assert len(old) == len(new) or "." in old
        assert all((x.isalpha(), x.isdigit(), x.isupper()) == (y.isalpha(), y.isdigit(), y.isupper()) for x, y in zip(old, new)) or "." in old
    assert rows[len(texts) - 3].text is None and rows[len(texts) - 1].text == rows[0].text


# given names, surname: words of seven scripts, none of which the operator lists
PEOPLE = [
    (["Ronald", "Reuel"], "Tolkienson"), (["Maximilian", "Konrad"], "Grünwald"), (["Пётр", "Иванович"], "Сидоров"), (["Γιώργος", "Νίκος"], "Παπαδόπουλος"), (["Արմեն", "Տիգրան"], "Պետրոսյան"),
    (["محمود", "حسن"], "الكرمي"), (["राजेश", "कुमार"], "वर्मा"), (["יוסף", "דוד"], "אברהמי"), (["Jean-Luc", "Henri"], "D'Aubigné"), (["Łucja", "Zofia"], "Kowalska-Żak"),
]


def test_no_part_of_a_name_stays(spark, make_docs):
    """Names of one to four words, with initials, particles and in capitals: words are looked for as plain text, not by the patterns."""
    texts, where = [], []
    for given, last in PEOPLE:
        cased = last[0].isupper()
        forms = [[last], [*given, last], [given[0], last], [*given, given[0], last]]
        if cased:
            forms += [[given[0][0] + ".", last], [given[0], given[1][0] + ".", last], [given[0], "von", "der", last], ["de", "la", last], [x.upper() for x in (*given, last)], [given[0][0], last]]
        for form in forms:
            for title in ("Dr", "Mrs.", "Señor", "PROF") if cased else ("Dr", "Frau"):
                where.append((last, form))
                texts.append(f"§{len(texts)} so {title} {' '.join(form)}, 5 of 7 said")
        where.append((given[0], [given[0]]))
        texts.append(f"§{len(texts)} so Dr {given[0]}, 5 of 7 said")
    texts.append("Mrs Smith's dog and Frau Anna, not Mme Dupont était élue")
    rows = {r.doc_id: r.text for r in pii.with_surrogates(make_docs(texts), KEY).collect()}
    words = {w for given, last in PEOPLE for w in (*given, last)}
    words |= {w.upper() for w in words}
    surname, first = {}, {}
    for i, (last, form) in enumerate(where):
        head, tail = rows[i].split(" so ")[0], rows[i].split(", ", 1)[1]
        assert (head, tail) == (f"§{i}", "5 of 7 said")
        new = rows[i].split(" so ")[1].split(", 5")[0].split(" ")[1:]
        assert len(new) == len(form), (texts[i], rows[i])
        for old, now in zip(form, new):
            if old in pii.PARTICLES:
                assert old == now
            elif not old.endswith(".") and len(old) > 1:
                assert now not in words and old != now, (texts[i], rows[i])
                assert [c.isalpha() for c in old] == [c.isalpha() for c in now] and old.isupper() == now.isupper()
            else:
                assert len(old) == len(now) and now.endswith(".") == old.endswith(".")
        told = new[-1]
        if form[-1] == last and form == [last] and any(last == given[0] for given, _ in PEOPLE):
            first.setdefault(last, set()).add(told)
        else:
            surname.setdefault(last, set()).add(told.upper())
            if len(form) == 2 and len(form[0]) > 2 and form[0] not in pii.PARTICLES:
                first.setdefault(form[0], set()).add(new[0])
    assert all(len(x) == 1 for x in surname.values()) and len({min(x) for x in surname.values()}) == len(PEOPLE)
    # a first name that stands alone has the surrogate that it has in whole names
    assert len(first) == len(PEOPLE) and all(len(x) == 1 for x in first.values())
    end = rows[len(where)]
    assert "Smith" not in end and "'s dog" in end and "Anna" not in end and "Dupont" not in end and end.endswith("était élue")


def test_phones_keep_their_country():
    for old, kept in (("+491701234567", "+49"), ("+15551234567", "+1"), ("+358401234567", "+358"), ("+79161234567", "+7"), ("030 1234567", "0"), ("0171/12345678", "0")):
        assert [k for _, _, k in pii.detect(f"call {old}.")] == ["phone"]
        new = pii.surrogate("phone", old, KEY)
        assert new.startswith(kept) and new != old and pattern(new) == pattern(old)


def test_ties_between_finds():
    """Overlapping finds go to the earlier pattern, one place to one entity."""
    for text in ('token = "abc@corp.com123"', "Dr 4111 1111 1111 1111", "Mr Anna Smith", "a@10.0.0.1.com 10.0.0.1"):
        found = pii.detect(text)
        assert all(b <= c for (_, b, _), (c, _, _) in zip(found, found[1:]))
    assert [k for _, _, k in pii.detect('token = "abcd@corp.com"')] == ["secret"]
