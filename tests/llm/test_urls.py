"""URL filters against a plain model."""

import random
import re
from collections import Counter, defaultdict
from math import floor, sqrt

from almanac.llm import common, queries, urls


def slow_parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.index(c) for c in "?#" if c in rest] + [len(rest)])]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def slow_rule(host, path, rules=urls.RULES):
    fit = [(len(r), r, v) for v, r in rules for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def slow_shape(seg):
    return re.sub("[0-9]+", "9", re.sub("[^0-9]+", "a", seg))


def same_rate(a, n, b, m, z):
    if not (n > 0 and m > 0):
        return True
    r = (a + b) / (n + m)
    return abs(a / n - b / m) <= z * sqrt(r * (1 - r) * (1 / n + 1 / m)) + 1e-9


def same_mean(a, n, b, m, squares, z):
    if not (n > 0 and m > 0):
        return True
    r = (a + b) / (n + m)
    return abs(a / n - b / m) <= z * sqrt(max(0, squares / (n + m) - r * r) * (1 / n + 1 / m)) + 1e-9


def merges(stat, shapes, t):
    """{segment: name of what it merges to, or None}. stat: of each segment n, paths, labelled, blocked, and the
    depths and next segments of its URLs, one by one."""
    out = dict.fromkeys(stat)
    classes = defaultdict(list)
    for s, x in stat.items():
        classes[shapes[s], floor(sum(x["depth"]) / x["n"] + 0.5)].append(s)
    for (form, depth), members in classes.items():
        like = []
        for s in members:
            a, others = stat[s], [stat[o] for o in members if o != s]
            if others:
                m = sum(o["n"] for o in others)
                depths = [d for o in others for d in o["depth"]]
                like += [s] * (
                    same_mean(sum(a["depth"]), a["n"], sum(depths), m, sum(d * d for d in a["depth"] + depths), t.z)
                    and same_rate(sum(a["digit"]), a["n"], sum(sum(o["digit"]) for o in others), m, t.z)
                    and same_rate(a["paths"], a["n"], sum(o["paths"] for o in others), m, t.z)
                )
        side = {s: "b" if 2 * stat[s]["blocked"] >= stat[s]["labelled"] else "a" for s in like if stat[s]["labelled"] >= t.evidence}
        weight = Counter()
        for s, which in side.items():
            weight[which] += stat[s]["labelled"]
        for s in like:
            if s in side:
                others = [stat[o] for o in side if o != s and side[o] == side[s]]
                a, n, b, m = stat[s]["blocked"], stat[s]["labelled"], sum(o["blocked"] for o in others), sum(o["labelled"] for o in others)
                name = side[s] if same_rate(a, n, b, m, t.z) else None
            else:
                name = next((w for w in "ba" if weight[w] and weight[w] >= t.purity * sum(weight.values())), "u")
            out[s] = name and f"#={form}:{depth}:{name}"
    return out


def slow_templates(count, ruled, t):
    """The template of each (host, path), by plain recursion over nodes."""
    out = {}

    def grow(name, members, at):
        kids = defaultdict(list)
        for k in members:
            kids[parts[k][at] if at < len(parts[k]) else "#."].append(k)
        whole = sum(count[k] for k in members)
        for k in kids.pop("#.", []):
            out[k] = f"{name}/#."
        n = {s: sum(count[k] for k in ks) for s, ks in kids.items()}
        stays = [s for s in kids if n[s] >= t.least and n[s] >= t.share * whole]
        stat = {}
        for s in stays:
            each = [k for k in kids[s] for _ in range(count[k])]
            stat[s] = {"n": n[s], "paths": len(kids[s]), "labelled": sum(ruled[k][1] is not None for k in each), "blocked": sum(ruled[k][1] == "block" for k in each)}
            stat[s] |= {"depth": [len(parts[k]) - at - 1 for k in each], "digit": [bool(len(parts[k]) > at + 1 and re.search("[0-9]", parts[k][at + 1])) for k in each]}
        token = merges(stat, {s: slow_shape(s) for s in stays}, t)
        merged = defaultdict(list)
        for s in stays:
            merged[token[s] or s] += kids[s]
        for name_, ks in merged.items():
            grow(f"{name}/{name_}", ks, at + 1)
        rare = [k for s in kids if s not in stays for k in kids[s]]
        if rare:
            grow(f"{name}/#*", rare, at + 1)

    parts = {k: [x for x in k[1].split("/") if x] for k in count}
    for host in {h for h, _ in count}:
        grow(host, [k for k in count if k[0] == host], 0)
    return out


def slow(rows, t=urls.Templates(), rules=urls.RULES):
    seen = [(i, *slow_parse(u)) for i, u in rows]
    ruled = {(h, p): slow_rule(h, p, rules) for _, h, p in seen}
    count = Counter((h, p) for _, h, p in seen)
    template = slow_templates(count, ruled, t)
    lab, blk, host_lab, host_blk = Counter(), Counter(), Counter(), Counter()
    for k, n in count.items():
        for total, wanted in ((lab, ruled[k][1] is not None), (blk, ruled[k][1] == "block")):
            total[template[k]] += n * wanted
        host_lab[k[0]] += n * (ruled[k][1] is not None)
        host_blk[k[0]] += n * (ruled[k][1] == "block")
    corpus = sum(blk.values()) / max(1, sum(lab.values()))
    out = []
    for i, h, p in seen:
        (rule, verdict), tpl = ruled[h, p], template[h, p]
        rate = (host_blk[h] + t.prior * corpus) / (host_lab[h] + t.prior)
        bad = lab[tpl] >= t.evidence and (blk[tpl] + t.prior * rate) / (lab[tpl] + t.prior) >= t.purity
        out.append((i, h, p, rule, verdict or ("block" if bad else "allow"), tpl))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.template) for r in df.collect()), key=str)


def test_whole_tables(spark):
    for sf in ("sf0.01", "sf0.1"):
        d = f"/root/testdata/{sf}"
        rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").collect()]
        assert got(queries.op9_url_filters(spark, d)) == slow(rows)


def test_rules_and_odd_urls(spark):
    rows = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://m.example.com/en/", "http://example.com", "http://example.com?u=://a/b", "https://a.net/es/é\n/x", "http://a.net/en/1/2/3/4/5/6/7", "ftp://É.com/", "http://notexample.com/en/", "http://com/", "://x.net/fr/a", "http://a.net//fr/", "http://a.net/fr/"]
    rows = list(enumerate(rows)) + [(100 + i, f"http://b.net/{'es' if i % 2 else 'q'}/{i}") for i in range(60)] + [(200 + i, "http://b.net/es") for i in range(9)] + [(None, "http://b.net/es"), (None, "http://b.net/es")]
    df = spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, host string")
    assert got(urls.judge_urls(df)) == slow(rows)
    assert urls.judge_urls(df.where("false")).collect() == []


def test_pure_templates_are_rejected(spark):
    rules = (("block", "a.org/x/bad-"), ("allow", "a.org/y/"))
    rows = [(i, f"http://a.org/x/bad-{i}") for i in range(40)] + [(50 + i, f"http://a.org/x/other-{i}") for i in range(5)] + [(60 + i, f"http://a.org/y/{i}") for i in range(40)] + [(200, "http://a.org/z/1")]
    out = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert out[52] == "block" and out[200] == "allow" and out[61] == "allow"


def test_no_evidence_means_no_block(spark):
    """With over 0.75 of all labelled URLs blocked, URLs without labels of their own stay."""
    rules = (("block", "a.net/x/"), ("allow", "b.net/"))
    rows = [(i, f"http://a.net/x/{i}") for i in range(90)] + [(100 + i, f"http://b.net/{i}") for i in range(10)] + [(200 + i, f"http://c{i}.org/p/{i}") for i in range(30)]
    rows += [(300, None), (301, "no scheme"), (302, "http://a.net/y/1")] + [(400 + i, f"http://a.net/y/{i}/z") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    out = {r.page_id: r.verdict for r in urls.judge_urls(df, rules).collect()}
    assert all(out[i] == "allow" for i in out if i >= 200) and got(urls.judge_urls(df, rules)) == slow(rows, rules=rules)


def test_unlabelled_branches_take_the_evidence_of_like_ones(spark):
    """es and fr are blocked; it and pt look the same; q is deeper. On the second host half is allowed, so nothing is told."""
    rules = (("block", "a.net/es/"), ("block", "a.net/fr/"), ("block", "b.net/es/"), ("allow", "b.net/fr/"))
    rows = [(1000 * h + 100 * k + i, f"http://{host}/{lang}/{i * 7 + k}") for h, host in enumerate(("a.net", "b.net")) for k, lang in enumerate(("es", "fr", "it", "pt")) for i in range(50)]
    rows += [(5000 + i, f"http://a.net/qq/x/{i}/y") for i in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    out = got(urls.judge_urls(df, rules))
    assert out == slow(rows, rules=rules)
    verdict = {i: v for i, _, _, _, v, _ in out}
    assert all(v == ("block" if i < 400 or 1000 <= i < 1100 else "allow") for i, v in verdict.items()) and len(verdict) == 450


def decided(rows, templates, t=urls.Templates()):
    """(URLs without a rule, of these: on hosts with labels, in templates with evidence)."""
    labels, hosts = Counter(), Counter()
    for _, host, _, rule, _, template in rows:
        labels[template] += rule is not None
        hosts[host] += rule is not None
    free = [r for r in rows if r[3] is None]
    return len(free), sum(hosts[r[1]] > 0 for r in free), sum(labels[r[5]] >= t.evidence for r in free)


def test_the_tree_decides_on_labelled_hosts(spark):
    free, on_labelled, told = decided(got(queries.op9_url_filters(spark, "/root/testdata/sf0.1")), urls.Templates())
    assert (free, on_labelled) == (1395, 651) and told >= 0.6 * on_labelled


def test_trees_of_any_shape(spark):
    """Deep paths, segments that look like tokens, branches that merge or not, repeats: as the plain recursion has it."""
    rng = random.Random(2)
    rules = (("block", "a.net/s/bad"), ("allow", "a.net/s/good"), ("block", "b.net/"))
    rows = []
    for i in range(900):
        host = rng.choice(["a.net", "a.net", "b.net", "c.org"])
        depth = rng.choice([0, 1, 2, 3, 4, 5, 9, 12])
        segs = [rng.choice(["s", "bad", "good", "*", "+", ".", "#*"[1:], "n%d" % rng.randrange(4), str(rng.randrange(500)), "é"]) for _ in range(depth)]
        rows.append((i, f"http://{host}/" + "/".join(segs)))
    rows += [(2000 + i, "http://d.org/" + "/".join("deep" for _ in range(9)) + f"/{i % 5}") for i in range(20)]
    rows += [(3000 + i, f"http://e.org/l{i % 6}/{i}.html") for i in range(120)] + [(4000 + i, f"http://e.org/m{i % 2}/x/y/z") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    out = got(urls.judge_urls(df, rules))
    assert out == slow(rows, rules=rules)
    by = {i: tpl for i, *_, tpl in out}
    assert by[3000] == "e.org/#=a9:1:u/#*/#." and len({by[3000 + i] for i in range(120)}) == 1 and by[4000] != by[3000]


def test_sums_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "SMALL_ROWS", 0)
    rows = [(i, f"http://b.net/{'es' if i % 2 else 'q'}/{i}") for i in range(50)] + [(60 + i, "http://b.net/q") for i in range(5)] + [(99, None), (100, "http://c.net/fr/1")]
    assert got(urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"))) == slow(rows)
