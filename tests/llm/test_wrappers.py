import re

from retrievium.llm import wrappers as W

PAGES = "page_id long, url string, html string, host string"


def page(title, paras, ad=False):
    return f"<html><body><h1>Site</h1><div class='t'>{title}</div>" + ("<p class='ad'>Buy</p>" if ad else "") + "".join(f"<p>{p}</p>" for p in paras) + "<footer>All rights</footer></body></html>"


def test_wrapper_and_fields(spark):
    long = "word " * 40
    rows = [(i, f"http://a.org/{i}", page(f"T{i}", [f"{long}{i}-{j}" for j in range(1 + i % 3)], i % 2 == 0), "x") for i in range(6)]
    for most in (1000, 0):  # by broadcast, and by shuffle
        got = {r.page_id: r for r in W.extract(spark.createDataFrame(rows, PAGES), most).collect()}
        assert all(got[i].text.split("\n") == [f"{long}{i}-{j}" for j in range(1 + i % 3)] for i in range(6))
        assert all("Site" not in [f.text for f in got[i].fields] and "All rights" not in [f.text for f in got[i].fields] for i in range(6))
    w = W.Wrapper([W.stream(r[2])[0] for r in rows], [1] * 6)
    assert ")+" in w.regex() and ")?" in w.regex()


def test_template_is_on_all_of_several_pages(spark):
    one, other = "<div>Site</div><p>first {}</p>", "<div>Site</div><table><td>only here</td></table><p>first {}</p>"
    rows = [(i, f"http://a.org/{i}", one.format(i), "x") for i in range(3)] + [(3, "http://a.org/3", other.format(3), "x"), (4, "http://a.org/4", "", "x")]
    rows += [(5, "http://b.org/1", "<h1>head</h1>", "x"), (6, "http://b.org/2", "<ul><li>item</ul>", "x")]  # no slot in common
    rows += [(7, "http://c.org", "<p>again</p><b>and</b>", "x")] * 2 + [(8, "http://c.org", None, "x")]  # one page, repeated
    for most in (1000, 0):
        got = {r.page_id: r for r in W.extract(spark.createDataFrame(rows, PAGES), most).collect()}
        fields = {i: [f.text for f in r.fields] for i, r in got.items()}
        assert fields == {0: ["first 0"], 1: ["first 1"], 2: ["first 2"], 3: ["only here", "first 3"], 4: [], 5: ["head"], 6: ["item"], 7: ["again", "and"], 8: []}
        assert got[3].text == "only here\nfirst 3" and got[5].text == "head" and got[6].text == "item" and got[7].text == "again\nand"


def test_odd_rows(spark):
    big = "<p>" + "y" * 300_000 + "</p>"
    rows = [(1, None, None, "h"), (2, "", "", "h"), (None, "http://b.org/x", "<p>one<p>two < three", "h"), (3, "not a url", "plain", "h"), (4, "http://c.org", big, "h"), (4, "http://c.org", big, "h"), (5, "http://d.org", "<!-- c --><script>var x = '<p>no</p>'</script><b>yes</b>", "h")]
    got = W.extract(spark.createDataFrame(rows, PAGES)).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 7 and by[1].text == "" and by[2].text == "" and by[5].text == "yes" and "two < three" in by[None].text
    assert W.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_tandems_and_alignment_equal_brute_force(rng, monkeypatch):
    monkeypatch.setattr(W, "SHORT", 0)
    tandem = re.compile(r"(.+?)\1+", re.S)
    for _ in range(1500):
        s = "".join(rng.choice(list("abc"[: rng.integers(1, 4)]), rng.integers(0, 25)))
        s = s[:5] * 3 + s if rng.random() < 0.3 else s
        assert W._tandems(s) == [m[1] for m in tandem.finditer(s)]

    def longest(a, b):
        if not a or not b:
            return 0
        return 1 + longest(a[1:], b[1:]) if a[0] == b[0] else max(longest(a[1:], b), longest(a, b[1:]))

    for _ in range(300):
        a, b = (list(rng.choice(list("abcd"), rng.integers(0, 8))) for _ in range(2))
        pairs = W._common(a, b)
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_records_of_any_length_are_one_group(spark):
    record = "".join(f"<i{k}>{{0}}-{k}</i{k}>" for k in range(40))  # 120 signs
    html = lambda i: "<h1>Site</h1><div>" + "".join(record.format(f"p{i}r{j}") for j in range(2 + i % 3)) + "</div>"
    rows = [(i, f"http://a.org/{i}", html(i), "x") for i in range(5)]
    w = W.Wrapper([W.stream(r[2])[0] for r in rows], [1] * 5)
    assert w.regex().count("#text") == 41 and w.regex().count(")+") == 1
    got = {r.page_id: r for r in W.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(5):
        assert [f.text for f in got[i].fields] == [f"p{i}r{j}-{k}" for j in range(2 + i % 3) for k in range(40)]
        assert [f.slot for f in got[i].fields] == list(range(1, 41)) * (2 + i % 3)


def test_wrapper_matches_the_streams_it_came_from(rng):
    for _ in range(60):
        rows = ["<u>x</u>" * rng.integers(0, 4), "<p>a<b>c</b></p>" * rng.integers(0, 3), "<li>q</li><hr>" * rng.integers(1, 4)]
        pages = ["".join(x * (rng.random() < 0.8) for x in rng.permutation(rows)) + "<footer>e</footer>" for _ in range(5)]
        streams = [list(s) for s in dict.fromkeys(tuple(W.stream(p)[0]) for p in pages)]
        w = W.Wrapper(streams, [1] * len(streams))

        def shown(x):
            return "(?:" + "".join(map(shown, w.bodies[x])) + ")+" if x in w.bodies else re.escape(x)

        whole = re.compile("".join(f"(?:{shown(x)})?" if o else shown(x) for x, o in zip(w.items, w.optional)))
        for i, s in enumerate(streams):
            assert whole.fullmatch("".join(w.letters[x] for x in s))
            assert len(w.slots(i, s)) == s.count(W.TEXT)
