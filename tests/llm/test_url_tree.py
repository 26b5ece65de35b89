"""The template tree against brute force, level by level in plain Python, and paths of a thousand segments."""

import math
import random
import re
import time
from collections import defaultdict

from hexweave.llm import url_filters as uf

RULES = (("allow", "a.com/good/"), ("block", "a.com/bad/"), ("allow", "b.com/"), ("block", "b.com/x/y/"))


def split(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url)
    return (m.group(1).lower(), m.group(2)) if m else ("", "")


def rule(host, path):
    best = None
    for action, r in RULES:
        at, _, start = r.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + start) and (best is None or len(r) > len(best[1])):
            best = action, r
    return best


def brute(urls):
    """Verdicts by one level at a time, without any step over common beginnings."""
    counts = defaultdict(lambda: [0, 0, 0])
    for url in urls:
        host, path = split(url)
        segments = tuple("*" if re.match(uf.ITEM, x) else x for x in path.split("/") if x)
        found = rule(host, path)
        c = counts[host, segments]
        c[0] += 1
        c[1] += found is not None
        c[2] += found is not None and found[0] == "block"
    template = {k: () for k in counts}
    for level in range(max(len(s) for _, s in counts) + 1):
        here = [k for k in counts if len(k[1]) >= level]
        nodes, parents = defaultdict(lambda: [0, 0, 0]), defaultdict(dict)
        for k in here:
            seg = k[1][level] if level < len(k[1]) else ""
            for i in range(3):
                nodes[k[0], template[k], seg][i] += counts[k][i]
        for (host, t, seg), c in nodes.items():
            parents[host, t][seg] = c
        to = {}
        for (host, t), children in parents.items():
            n, labelled, blocked = (sum(c[i] for c in children.values()) for i in range(3))
            for seg, c in children.items():
                close = None
                if c[1] and labelled:
                    rate = blocked / labelled
                    close = abs(c[2] / c[1] - rate) <= uf.Z * math.sqrt(rate * (1 - rate) / c[1])
                rare = len(children) > uf.MANY and c[0] < uf.SHARE * n and (c[1] < uf.PRIOR or bool(close))
                to[host, t, seg] = seg if seg == "" else "*" if rare or (len(children) > 1 and close) else seg
        for k in here:
            seg = k[1][level] if level < len(k[1]) else ""
            if seg:
                template[k] += (to[k[0], template[k], seg],)
    own, shared = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for k, c in counts.items():
        for table, key in ((own, (k[0], template[k])), (shared, template[k])):
            table[key][0] += c[1]
            table[key][1] += c[2]
    base = (sum(c[2] for c in counts.values()) + 1) / (sum(c[1] for c in counts.values()) + 2)
    out = []
    for i, url in enumerate(urls):
        host, path = split(url)
        segments = tuple("*" if re.match(uf.ITEM, x) else x for x in path.split("/") if x)
        t = template[host, segments]
        everywhere = (shared[t][1] + uf.PRIOR * base) / (shared[t][0] + uf.PRIOR)
        p = round((own[host, t][1] + uf.PRIOR * everywhere) / (own[host, t][0] + uf.PRIOR), 9)
        found = rule(host, path)
        out.append((i, "/" + "/".join(t), round(p, 6), found[0] if found else "block" if p > 0.5 else "allow"))
    return out


def judged(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)
    return sorted((r["page_id"], r["template"], round(r["p_block"], 6), r["verdict"]) for r in uf.url_filters(df, RULES).collect())


def crawl(seed=9, n=1500):
    rng = random.Random(seed)
    names = ["good", "bad", "x", "y", "news", "shop", "help", "page", "Δ"]
    urls = []
    for _ in range(n):
        host = rng.choice(["a.com", "a.com", "www.a.com", "b.com", "c.org"])
        path = [rng.choice(names) for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.3:
            path = path[:1] + [f"k{rng.randint(0, 40)}"] + path[1:]
        if rng.random() < 0.3:
            path.append(str(rng.randint(0, 50)))
        urls.append(f"https://{host}/{'/'.join(path)}{rng.choice(['', '/', '?q=1'])}")
    urls += [f"http://b.com/{s}/page/{i % 7}" for s in ("fr", "es", "it") for i in range(60)]  # siblings that are all allowed
    return urls + ["", "nothing", "http://a.com", "http://a.com/good//bad/"] * 2


def test_brute_force_tree(spark):
    urls = crawl()
    assert judged(spark, urls) == brute(urls)


def test_pure_siblings_are_merged(spark):
    urls = [f"http://b.com/{s}/page/{i}" for s in ("fr", "es", "it") for i in range(50)]
    assert {t for _, t, _, _ in judged(spark, urls)} == {"/*/page/*"}


def test_paths_of_a_thousand_segments(spark):
    """Rounds follow branching: one long path, and two that part near their ends, among ten thousand."""
    long = "/".join(f"s{i}" for i in range(1000))
    urls = [f"http://b.com/{i % 50}a/{i % 7}b/{i}" for i in range(10_000)]
    urls += [f"http://trap.net/{long}", f"http://other.net/{long}/end", f"http://other.net/{long}/last/one"]
    start = time.time()
    found = judged(spark, urls)
    assert time.time() - start < 60
    assert found[10_000][1] == f"/{long}" and found[10_001][1] == f"/{long}/end"
