import pytest
from pyspark.sql import functions as F

from wirelight.operators import lookup
from wirelight.operators.domains import domain_join, drop_trusted
from wirelight.operators.scope import (
    fold_verdicts, groups_of_src, scope_dns, scope_http, scope_ip, scope_join,
)
from wirelight.operators.special import drop_special
from wirelight.functions.names import (
    clean_path, is_domain_name, join_clean_path, trusted_by, url_host,
)
from wirelight.sources.scope_file import ScopeGroup, load_scope, scope_frame

G = ScopeGroup


def _dns(spark, groups, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "id int, query string, srcIP string, destIP string")
    return [r.keep for r in scope_dns(df, groups, flag=True, use_dest=True).orderBy("id").collect()]


DNS_CASES = [
    ([G("any", in_scope=("0.0.0.0/0",))], [("a", "10.0.0.0", "10.0.0.0")], [True]),
    ([G("p1", in_scope=("10.0.0.0/8",)), G("p2", in_scope=("192.168.0.0/16",))],
     [("a", "10.0.0.0", "0.0.0.0"), ("a", "192.168.0.0", "0.0.0.0"), ("a", "11.0.0.0", "0.0.0.0")],
     [True, True, False]),
    ([G("p1", in_scope=("10.0.0.0/8",), out_scope=("10.1.0.0/16",)), G("p2", in_scope=("10.0.0.0/8",), out_scope=("10.2.0.0/16",))],
     [("a", "10.0.0.1", None), ("a", "10.1.0.1", None), ("a", "10.2.0.1", None)], [True, False, False]),
    ([G("d", trusted_domains=("a.com", "*.b.com"))],
     [("a.com", "10.0.0.1", None), ("x.a.com", "10.0.0.1", None), ("B.com", "::1", None), ("x.y.b.com", "10.0.0.1", None),
      ("xb.com", "10.0.0.1", None), ("b.com.", "10.0.0.1", None), ("", "10.0.0.1", None), ("a", None, None), ("a", "bad", None)],
     [False, True, False, False, True, True, False, False, False]),
    ([G("t", trusted_ips=("8.8.0.0/16",))],
     [("a", "10.0.0.1", "8.8.8.8"), ("a", "10.0.0.1", "8.9.8.8"), ("a", "10.0.0.1", None)], [False, True, True]),
    ([], [("a", "10.0.0.1", None), ("", None, None)], [True, True]),
]


@pytest.mark.parametrize("case", range(len(DNS_CASES)))
def test_dns_verdicts(spark, case):
    groups, rows, want = DNS_CASES[case]
    assert _dns(spark, groups, rows) == want


def test_ip_http_and_special(spark):
    df = spark.createDataFrame(
        [(1, "10.0.0.1", "8.8.8.8", "in"), (2, "10.0.0.1", "10.0.0.2", "out"), (3, "8.8.8.8", "10.0.0.1", "in"),
         (4, "fd00::1", "2600::1", "unknown"), (5, None, "1.1.1.1", "out"), (6, "::ffff:10.0.0.1", "1.1.1.1", "out"),
         (7, "10.0.0.1", None, "out")],
        "id int, srcIP string, destIP string, direction string")
    got = {r.id: (r.keep, r.reason) for r in scope_ip(df, load_scope(), flag=True).collect()}
    assert got == {1: (True, None), 2: (False, "default"), 3: (False, "<no-match>"), 4: (True, None),
                   5: (False, "<no-data>"), 6: (True, None), 7: (False, "<no-data>")}
    assert {r.id for r in scope_ip(df, load_scope()).collect()} == {1, 4, 6}
    assert {r.id for r in drop_special(df).collect()} == {3, 4, 5, 6, 7}
    urls = spark.createDataFrame(
        [(1, "http://a.lan/x", "10.0.0.1"), (2, "https://A.B.lan:80/x?y", "10.0.0.1"), (3, "x.com/lan", "10.0.0.1"),
         (4, "/only/path", "10.0.0.1"), (5, "", "10.0.0.1"), (6, "x.com", "9.9.9.9")], "id int, url string, srcIP string")
    got = {r.id: (r.keep, r.reason) for r in scope_http(urls, load_scope(), flag=True).collect()}
    assert got == {1: (False, "default"), 2: (False, "default"), 3: (True, None), 4: (True, None),
                   5: (False, "<no-data>"), 6: (False, "<no-match>")}


def _mixed_groups():
    return [
        G("a", "A", ("10.0.0.0/8", "fc00::/7"), ("10.9.0.0/16",), ("10.0.0.0/8",), ("*.lan", "x.org")),
        G("b", "B", ("10.1.0.0/16",), (), ("8.8.8.8/32",), ("*.b.org",)),
        G("c", "C", (), ("172.16.0.0/12",), ("224.0.0.0/4",), ()),
    ]


@pytest.mark.parametrize("tiny", [False, True])
def test_join_form_agrees_with_literal_form(spark, monkeypatch, tiny):
    if tiny:
        monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(lookup, "HOT_KEYS", 1)
    srcs = ["10.0.0.1", "10.1.0.1", "10.9.0.1", "172.16.3.4", "9.9.9.9", "fd00::5", "bad", None]
    dsts = ["8.8.8.8", "1.1.1.1", "10.2.0.1", "230.0.0.1", None]
    names = ["q.lan", "x.org", "y.x.org", "z.b.org", "n.com", "", None]
    df = spark.range(280).selectExpr("id").withColumns({
        "srcIP": F.get(F.array(*map(F.lit, srcs)), (F.col("id") % 8).cast("int")),
        "destIP": F.get(F.array(*map(F.lit, dsts)), (F.col("id") % 5).cast("int")),
        "query": F.get(F.array(*map(F.lit, names)), (F.col("id") % 7).cast("int")),
    }).withColumn("url", F.concat(F.lit("http://"), "query", F.lit("/x")))
    groups = _mixed_groups()
    scope = scope_frame(spark, groups)
    forms = {"ip": scope_ip, "dns": scope_dns, "http": scope_http}
    for kind, literal in forms.items():
        want = sorted((r.id, r.keep, r.reason) for r in literal(df, groups, flag=True).collect())
        got = sorted((r.id, r.keep, r.reason) for r in scope_join(df, scope, kind, flag=True).collect())
        assert got == want, kind
        assert len({x[2] for x in want}) >= 3


def _verdicts(rows):
    return sorted((r.id, r.keep, r.reason) for r in rows.collect())


def test_scope_join_with_destinations(spark):
    """dst_includes, use_dest, an empty scope and networks of mapped addresses, as in the literal forms."""
    groups = [
        G("a", in_scope=("10.0.0.0/8",), out_scope=("10.9.0.0/16",), dst_includes=("8.8.0.0/16",), trusted_ips=("8.8.8.8",), trusted_domains=("*.lan",)),
        G("b", in_scope=("::ffff:172.16.0.0/108", "fd00::/8"), dst_includes=("8.0.0.0/8", "2001:db8::/32"), trusted_domains=("ok.org",)),
        G("c", out_scope=("192.168.0.0/16",), dst_includes=("1.1.1.1/32",)),
    ]
    sources = ["10.0.0.1", "10.9.0.1", "172.16.3.4", "192.168.1.1", "fd00::7", "bad", None]
    targets = ["8.8.8.8", "8.8.4.4", "8.1.1.1", "1.1.1.1", "2001:db8::1", "9.9.9.9", "bad", None]
    names = ["a.lan", "ok.org", "x.ok.org", "", None]
    rows = [(i, s, t, n, None if n is None else f"http://{n}/") for i, (s, t, n) in enumerate((s, t, n) for s in sources for t in targets for n in names)]
    df = spark.createDataFrame(rows, "id int, srcIP string, destIP string, query string, url string")
    scope = scope_frame(spark, groups)
    for kind, literal in {"ip": scope_ip, "dns": scope_dns, "http": scope_http}.items():
        assert _verdicts(scope_join(df, scope, kind, flag=True)) == _verdicts(literal(df, groups, flag=True)), kind
    assert _verdicts(scope_join(df, scope, "dns", True, use_dest=True)) == _verdicts(scope_dns(df, groups, True, use_dest=True))
    assert scope_join(df, scope_frame(spark, []), "ip").count() == len(rows)
    assert _verdicts(scope_join(df, scope_frame(spark, []), "dns", True)) == _verdicts(scope_dns(df, [], True))


@pytest.mark.parametrize("column, entry", [("in_scope", "10.0.0.1"), ("in_scope", "10.0.0.0/33"), ("out_scope", "10.0.0"), ("dst_includes", "x/8"),
                                           ("trusted_ips", None), ("trusted_domains", "a..b"), ("trusted_domains", None)])
def test_scope_join_refuses_malformed_entries(spark, column, entry):
    scope = scope_frame(spark, [G("a", in_scope=("10.0.0.0/8",))]).withColumn(column, F.array(F.lit(entry)).cast("array<string>"))
    df = spark.createDataFrame([("10.0.0.1", "8.8.8.8", "q.org")], "srcIP string, destIP string, query string")
    with pytest.raises(Exception, match="is not"):
        scope_join(df, scope, "dns" if column == "trusted_domains" else "ip").collect()


def test_groups_of_src(spark):
    df = spark.createDataFrame([("10.1.0.1",), ("10.9.0.1",), ("172.16.0.1",), (None,)], "srcIP string")
    got = [[g.label for g in r.g] for r in groups_of_src(df, _mixed_groups(), "g").collect()]
    assert got == [["a", "b", "c"], ["c"], [], []]
    assert groups_of_src(df, [], "g").first().g == []


def test_fold_verdicts(spark):
    rows = [(1, "a", True, False), (1, "b", False, False), (2, "b", True, True), (2, "a", True, False),
            (3, "a", False, True), (4, "z", True, True), (4, "k", True, True)]
    df = spark.createDataFrame(rows, "id int, name string, matched boolean, excluded boolean")
    got = {r.id: (r.keep, r.reason) for r in fold_verdicts(df, "id").collect()}
    assert got == {1: (True, None), 2: (False, "b"), 3: (False, "<no-match>"), 4: (False, "k")}


def test_domain_names(spark):
    cases = {"a": True, "a.b": True, "a.b.": True, "1.2": False, "_x.y": True, "-a": False, "a-": False, "a-.b": False,
             "a..b": False, ".a": False, ".": False, "": False, "a b": False, "x" * 63 + ".a": True, "x" * 64: False,
             "*.a": False, ("a" * 49 + ".") * 5 + "abcd": False, ("a" * 49 + ".") * 5 + "abc.": True,
             ("a" * 49 + ".") * 5 + "abc": True, "a\n": False}
    df = spark.createDataFrame(list(cases.items()), "n string, want boolean")
    assert df.where(is_domain_name("n") != F.col("want")).collect() == []


def test_domain_patterns(spark, monkeypatch):
    names = ["a", "x.a", "y.x.a", "xa", "a.", ".a", "b.c", "z.b.c", "c", "", None, "X.A"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    pats = ["*.a", "b.c"]
    want = {"a", "x.a", "y.x.a", ".a", "b.c", "X.A"}
    assert {r.n for r in df.where(trusted_by("n", pats)).collect()} == want
    table = spark.createDataFrame([(p, p) for p in pats + ["bad domain"]], "p string, tag string")
    got = {r.n for r in domain_join(df, "n", table, "p", "tag", "t").collect() if r.t}
    assert got == want
    rest = {r.n for r in drop_trusted(df, "n", table, "p").collect()}
    assert rest == set(names) - want
    monkeypatch.setattr("wirelight.operators.domains.LITERAL_LIMIT", 0)
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    assert {r.n for r in drop_trusted(df, "n", table, "p").collect()} == rest


def test_paths_and_hosts(spark):
    paths = {("h", "/a//b/./c/"): "h/a/b/c", ("h", ""): "h", ("h", "/../x"): "x", ("h", "/.."): ".", ("", "/a/"): "/a",
             ("h", "a?u=http://x"): "h/a?u=http:/x", ("h", "/a/../b"): "h/b", ("", ""): "", ("..", "../x"): "../../x",
             ("h", "/a.b/..c"): "h/a.b/..c", ("/", ".."): "/"}
    df = spark.createDataFrame([(h, p, w) for (h, p), w in paths.items()], "h string, p string, w string")
    bad = df.withColumn("got", join_clean_path("h", "p")).where("got != w")
    assert bad.collect() == []
    hosts = {"http://A.b:80/x": "a.b", "a.b/x": "a.b", "https://h": "h", "/x": None, "": None, "u:8080": "u", "ftp://x_y?z": "x_y"}
    df = spark.createDataFrame(list(hosts.items()), "u string, w string")
    assert df.where(~url_host("u").eqNullSafe(F.col("w"))).collect() == []


def test_scope_file(spark, tmp_path):
    f = tmp_path / "s.yml"
    f.write_text("groups:\n  g1:\n    label: L\n    in_scope: [10.0.0.0/8]\n    trusted_domains: ['*.x.y']\n  g0:\n")
    groups = load_scope(str(f))
    assert [g.name for g in groups] == ["g0", "g1"] and groups[1].label == "L"
    assert scope_frame(spark, groups).count() == 2
    d = load_scope()
    assert len(d) == 1 and len(d[0].in_scope) == 4 and len(d[0].trusted_ips) == 10 and len(d[0].trusted_domains) == 4
    for bad in ("group: {}", "groups: {a: {in_scop: []}}", "groups: {a: {in_scope: ['10.0.0.1']}}",
                "groups: {a: {trusted_domains: ['a b']}}"):
        f.write_text(bad)
        with pytest.raises(ValueError):
            load_scope(str(f))
