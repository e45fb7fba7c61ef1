import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from verifolio.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def slow_spans(text):
    found = [(m.start(), KINDS.index(k), k, m.end()) for k in KINDS for m in re.finditer(PATTERNS[k], text or "") if valid(k, m[0])]
    return sorted(found)


def digest(text):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in slow_spans(text))


def check(df, rows):
    expected = {}
    for doc_id, text in rows:
        joined = digest(text)
        counts = tuple(sum(s[2] == k for s in slow_spans(text)) for k in KINDS)
        expected.setdefault(doc_id, []).append((*counts, hashlib.sha256(joined.encode()).hexdigest()))
    got, spans = {}, {}
    for r in df.collect():
        got.setdefault(r.doc_id, []).append((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256))
        spans[r.doc_id] = r.spans
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    for doc_id, text in rows:
        base = set(digest(text).split(",")) - {""}
        assert base <= set(spans[doc_id].split(","))
    return spans


def test_documents(documents):
    check(pii.pii_digest(documents), documents.select("doc_id", "text").collect())


def test_odd_rows(odd, odd_rows, none):
    check(pii.pii_digest(odd), [r[:2] for r in odd_rows])
    assert pii.pii_digest(none).count() == 0


_parts = st.sampled_from(
    ["a", "b.c", "@", "x@y.zz", "_", "%", "1", "12", "255", "256", ".", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "10.0.0.1", "+1 (555) 123-4567", "é", "😀", "\n", "00"]
)


def test_adversarial_strings(spark):
    texts = []

    @settings(max_examples=400, deadline=None, database=None, derandomize=True)
    @given(st.lists(_parts, max_size=14))
    def collect(parts):
        texts.append("".join(parts))

    collect()
    rows = list(enumerate(texts))
    check(pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_long_runs_need_no_stack(spark):
    """Expected by hand: Python's matcher would take the square of a run's length."""
    n = 60000
    texts = ["1 " * n, "a." * n + "@", "1." * n, "x@" + "a." * n + "b", "+1" + "0" * n]
    found = pii.pii_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    counts = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in found}
    assert counts == {0: (0, 0, 0, 0), 1: (0, 0, 0, 0), 2: (0, n // 4, 0, 0), 3: (1, 0, 0, 0), 4: (0, 0, 0, 0)}
    rows = list(enumerate([t[:3000] for t in texts]))
    check(pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_confident_patterns_find_unseen_identifiers(spark):
    """Phones with a plus after one phrase teach that what else follows it is a phone."""
    rows = [(i, f"please call my number +1 (555) 123-{1000 + i} before noon") for i in range(12)]
    rows += [(50, "please call my number 555 987 6543 before noon"), (51, "the parcel weighs 555 987 6543 grams in all")]
    spans = check(pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")), rows)
    assert spans[50] == "phone:22:34" and spans[51] == ""


def test_recall_and_precision_of_added_spans(spark):
    """Planted identifiers that no base pattern finds, after phrases that seeds teach; the
    same shapes after other phrases are none."""
    rows, planted = [], {}
    for i in range(40):
        rows.append((i, f"you may reach me under +49 30 5551{1000 + i} today"))
        rows.append((100 + i, f"write to the address user{i}@mail{i}.example now"))
    for i in range(30):
        phone, mail = f"030 5552{1000 + i}", f"someone{i} (at) post{i} (dot) example"
        rows.append((200 + i, f"you may reach me under {phone} today"))
        rows.append((300 + i, f"write to the address {mail} now"))
        planted[200 + i], planted[300 + i] = f"phone:23:{23 + len(phone)}", f"email:21:{21 + len(mail)}"
        rows.append((400 + i, f"the part has number 030 5553{1000 + i} in stock"))
        rows.append((500 + i, f"they were (at) home{i} (dot) and slept"))
    found = {r.doc_id: r.spans for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = {d: s for d, s in found.items() if d >= 200 and s}
    right = sum(added.get(d) == s for d, s in planted.items())
    assert right / len(planted) >= 0.95 and right / len(added) >= 0.95


def test_discovered_identifiers_teach_further_patterns(spark):
    """A phrase that stands only beside identifiers found in an earlier round counts as well."""
    rows = [(i, f"please call my number +1 (555) 123-{1000 + i} before noon") for i in range(12)]
    rows += [(50 + i, f"please call my number 555 987 {6000 + i} before noon") for i in range(6)]
    rows += [(80 + i, f"fax line here 555 987 {6000 + i} always open") for i in range(6)] + [(99, "fax line here 555 987 9999 always open")]
    found = {r.doc_id: r.spans for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[50] == "phone:22:34" and found[99] == "phone:14:26"


def test_added_spans_leave_base_spans_alone(spark):
    rows = [(i, f"card on file 4111 1111 1111 {1111 if i == 0 else 1111} ok {i}") for i in range(3)]
    check(pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_mask(spark):
    rows = [(1, "write to a@b.cc now, from 10.0.0.1."), (2, None), (3, "nothing")]
    found = {r.id: r.text for r in pii.mask(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: "write to [email] now, from [ip].", 2: "", 3: "nothing"}
