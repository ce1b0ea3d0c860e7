"""URL parts, rules, and propagation against plain loops."""

import re
from collections import defaultdict

from trackhouse.llm import queries, urls


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fit = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name), default=None)


def brute(rows):
    """Trust and distrust of every host that has pages."""
    edges, marks = defaultdict(float), defaultdict(lambda: [0, 0, 0])
    hosts = set()
    for _, url, html in rows:
        host, path = parts(url)
        if host:
            hosts.add(host)
            rule = rule_of(host, path)
            marks[host][0] += 1
            marks[host][1] += rule is not None and rule.action == "allow"
            marks[host][2] += rule is not None and rule.action == "block"
            for other in re.findall(r"""(?i)href="(?:https?:)?//([^/?#"'\s>]+)""", html or ""):
                if other.lower() != host:
                    edges[host, other.lower()] += 1
                    hosts.add(other.lower())
    pairs = set()
    for host in hosts:
        while host.count(".") >= 2:
            parent = host.split(".", 1)[1]
            pairs |= {(host, parent), (parent, host)}
            host = parent
    for pair in pairs:
        edges[pair] += urls.PARENT_WEIGHT

    def rank(edges, seeds):
        total = defaultdict(float)
        for (a, _), w in edges.items():
            total[a] += w
        now, change = dict(seeds), 1.0
        while change > 1e-11:
            new = {h: s * (1 - urls.DAMPING) for h, s in seeds.items()}
            for (a, b), w in edges.items():
                if a in now:
                    new[b] = new.get(b, 0) + w / total[a] * now[a] * urls.DAMPING
            change = max((abs(v - now.get(h, 0)) for h, v in new.items()), default=0)
            now = new
        return now

    trust = rank(edges, {h: g / n for h, (n, g, _) in marks.items() if g})
    distrust = rank({(b, a): w for (a, b), w in edges.items()}, {h: b / n for h, (n, _, b) in marks.items() if b})
    return trust, distrust


def check(rows, got):
    trust, distrust = brute(rows)
    assert sorted(str(r.page_id) for r in got) == sorted(str(i) for i, *_ in rows)
    by_id = {i: url for i, url, _ in rows}
    for r in got:
        host, path = parts(by_id[r.page_id])
        assert (r.host, r.path) == (host, path)
        rule = rule_of(host, path)
        assert r.rule == (rule.name if rule else None)
        assert abs(r.trust - trust.get(host, 0)) < 1e-5 and abs(r.distrust - distrust.get(host, 0)) < 1e-5
        assert r.verdict == (rule.action if rule else "block" if r.distrust > r.trust else "allow")


def test_judged_like_plain_loops(spark):
    link = lambda *h: "".join(f'<a href="https://{x}/p">' for x in h)
    rows = [
        (1, "http://WWW.Example.com/en/x?q", link("a.site.org", "b.site.org")), (2, "http://example.com/en/", ""),
        (3, "https://m.bad.net/es/1", link("c.spam.org")), (4, "https://c.spam.org/en/", link("m.bad.net", "M.bad.net") * 5),
        (5, "https://a.site.org", None), (6, None, link("x.org")), (7, "no scheme", None), (8, "ftp://", "x"), (9, "http://x.com", None),
        (10, "http://deep.a.b.site.org/fr/#x://y", '<a href="/rel"><a href="//proto.net/x">'), (11, "http://fr.net/fr/?://z", ""), (12, "x://y\nz/fr/", ""),
    ]
    rows += [(100 + i, "http://hot.example.org/en/%d" % i, link("c.spam.org")) for i in range(30)]
    docs = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, host string")
    got = urls.judge(docs, queries.RULES).collect()
    check(rows, got)
    assert {r.page_id: r.verdict for r in got}[4] == "block"


def test_a_long_chain_is_followed_to_its_end(spark):
    """30 hosts, each linking to the one before; the first is blocked by rule."""
    rows = [(0, "https://bad.net/es/", "")] + [(i, f"https://h{i}.org/", f'<a href="//{"bad.net" if i == 1 else f"h{i - 1}.org"}/">') for i in range(1, 31)]
    rows += [(None, "https://h30.org/", ""), (None, "https://h30.org/", "")]
    docs = spark.createDataFrame(rows, "`page.id` long, url string, html string")
    got = urls.judge(docs, queries.RULES, id_col="page.id").collect()
    assert len(got) == 33 and all(r.verdict == "block" for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge(docs, queries.RULES).count() == 0


def test_query(spark, small_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect()]
    check(rows, queries.all_queries()["op10_link_trust"](spark, small_dir).collect())
