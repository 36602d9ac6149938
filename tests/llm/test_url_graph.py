import re
from collections import defaultdict

from driftgauge.llm.queries import RULES
from driftgauge.llm.url_graph import judge_urls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host):])[0]


def ruled(host, path):
    fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute(rows, damping=0.85, rounds=8, floor=0.25):
    pages = [(i, *parts(u), h or "") for i, u, h in rows]
    weight = defaultdict(float)
    hosts = {h for _, h, _, _ in pages if h}
    for _, host, _, html in pages:
        for target in re.findall(r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/"'?#>\s]+)""", html):
            if host and target.translate(LOWER) != host:
                weight[host, target.translate(LOWER)] += 1
    hosts |= {b for _, b in weight}
    steps = set()
    for host in hosts:
        labels = host.split(".")
        for k in range(len(labels) - 2):
            steps.add((".".join(labels[k:]), ".".join(labels[k + 1:])))
    for a, b in steps:
        weight[a, b] += 1
        weight[b, a] += 1
    share = {"allow": defaultdict(list), "block": defaultdict(list)}
    for _, host, path, _ in pages:
        if host:
            for v in share:
                share[v][host].append(ruled(host, path)[0] == v)
    score = {}
    for v, turn in (("allow", lambda a, b: (a, b)), ("block", lambda a, b: (b, a))):
        edges = {turn(a, b): w for (a, b), w in weight.items()}
        out = defaultdict(float)
        for (a, _), w in edges.items():
            out[a] += w
        seed = {h: sum(x) / len(x) for h, x in share[v].items()}
        total = sum(seed.values()) or 1
        seed = {h: x / total for h, x in seed.items() if x}
        now = dict(seed)
        for _ in range(rounds):
            new = defaultdict(float, {h: x * (1 - damping) for h, x in seed.items()})
            for (a, b), w in edges.items():
                new[b] += damping * now.get(a, 0) * w / out[a]
            now = new
        score[v] = now
    n = max(sum(1 for x in share["block"].values() if any(x)), 1)
    result = []
    for i, host, path, _ in pages:
        verdict, rule = ruled(host, path)
        bad = round(score["block"].get(host, 0), 12) > max(round(score["allow"].get(host, 0), 12), floor / n)
        result.append((i, host, path, rule, verdict or ("block" if bad else "allow")))
    return sorted(result, key=str)


def test_against_brute_force(spark):
    link = lambda *hosts: "".join(f'<a HREF="https://{h}/x">' for h in hosts)
    rows = [
        (1, "http://A.example.com/fr/1?x=1#y", link("b.net", "farm.org")), (2, "http://a.example.com/en/1", ""), (3, "https://www.example.com/en/2", link("good.org")),
        (4, "https://b.net/es/1", link("farm.org")), (5, "https://b.net/de/1", ""), (6, "https://farm.org/", link("b.net", "B.NET")), (7, "https://good.org/a#b", ""),
        (8, "https://other.org", None), (9, None, link("b.net")), (10, "no scheme", ""), (None, "https://farm.org?q", ""), (5, "https://b.net/de/1", ""),
        (11, "ftp://notexample.com/en/", ""), (12, "http://com/x", ""), (13, "http://example.com:80/en/", ""), (14, "http://example.com", ""), (15, "://", ""),
        (16, "http://sub.b.net/fr/x", link("farm.org") * 3), (17, "https://feeder.org/p", link("sub.b.net", "b.net")),
    ] + [(100 + i, "https://hot.org/%d" % i, link("b.net")) for i in range(60)]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id bigint, url string, html string, host string, verdict string")
    got = judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert {v for *_, v in brute(rows) if _[3] is None} == {"allow", "block"}


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert judge_urls(pages, RULES).collect() == []


def test_scores_are_those_of_the_converged_walk(spark):
    """A chain of 11 hosts behind the seeds and a star of subdomains, against a solved linear system."""
    import numpy as np

    from driftgauge.llm.url_graph import propagate

    chain = [f"h{i}" for i in range(11)]
    edges = [(a, b, 1.0) for a, b in zip(chain, chain[1:])] + [(chain[3], "hub", 2.0)]
    edges += [e for i in range(5) for e in ((f"s{i}.hub", "hub", 1.0), ("hub", f"s{i}.hub", 1.0))]
    seeds = [("h0", 0.75, 0.0), ("s0.hub", 0.25, 0.5), ("h10", 0.0, 0.5)]
    hosts = sorted({h for a, b, _ in edges for h in (a, b)})
    want = {}
    for k in (0, 1):
        step = np.zeros((len(hosts), len(hosts)))
        for a, b, w in edges:
            a, b = (a, b) if k == 0 else (b, a)
            step[hosts.index(b), hosts.index(a)] += w
        step /= np.maximum(step.sum(axis=0), 1e-300)
        start = np.zeros(len(hosts))
        for s in seeds:
            start[hosts.index(s[0])] = s[1 + k]
        want[k] = np.linalg.solve(np.eye(len(hosts)) - 0.85 * step, 0.15 * start)
    graph = spark.createDataFrame(edges, "src string, dst string, weight double")
    got = {r.host: r for r in propagate(graph, spark.createDataFrame(seeds, "host string, trust double, distrust double"), 0.85).collect()}
    assert want[0][hosts.index("h9")] > 0.005 and all(w > 0 for w in want[0])
    for i, host in enumerate(hosts):
        assert abs(got[host].trust - want[0][i]) < 2e-8 and abs(got[host].distrust - want[1][i]) < 2e-8
