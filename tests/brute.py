"""Plain Python statements of event merging, representative choice and group retrieval, written for the
tests only. They work on the normalised rows of one recording and serve as the exact answer."""

import math

STOP = set(
    "clear_fluid generic_instrument generic_material generic_object generic_structure red_fluid surface_region tissue tissue_region".split()
)
TERMINAL = {"attach", "cut", "remove", "tighten"}


def runs(links, cap):
    """Run number of each row, where links[i] says row i may follow row i-1."""
    out, run, size = [], -1, 0
    for link in links:
        if link and 0 < size < cap:
            size += 1
        else:
            run, size = run + 1, 1
        out.append(run)
    return out


def representatives(clips, moving, budget):
    """clips: dicts with index, predicates, informative, spec. Returns (index, reason) picks."""
    count_a, count_c = {}, {}
    for c in clips:
        for p in c["predicates"]:
            count_a[p] = count_a.get(p, 0) + 1
        for x in c["informative"]:
            count_c[x] = count_c.get(x, 0) + 1
    total_a, total_c = sum(1 / n for n in count_a.values()), sum(1 / n for n in count_c.values())
    picks, seen_a, seen_c = [], set(), set()

    def worth(c):
        a = sum(1 / count_a[p] for p in c["predicates"] - seen_a)
        x = sum(1 / count_c[k] for k in c["informative"] - seen_c)
        return 0.55 * (a / total_a if total_a else 0) + 0.25 * (x / total_c if total_c else 0) + 0.2 * c["spec"]

    def take(pool, reason):
        pool = [c for c in pool if c["index"] not in [i for i, _ in picks]]
        if pool and len(picks) < min(budget, len(clips)):
            best = sorted(pool, key=lambda c: (-round(worth(c), 12), c["index"]))[0]
            picks.append((best["index"], reason))
            seen_a.update(best["predicates"])
            seen_c.update(best["informative"])

    take(clips, "primary_event_coverage")
    take([c for c in clips if c["predicates"] & TERMINAL], "terminal_action_coverage")
    take([c for c in clips if c["index"] in moving], "action_transition_coverage")
    while len(picks) < min(budget, len(clips)):
        take(clips, "marginal_event_coverage")
    return picks


def event_score(q, e):
    hit = {k: set(q[k]) & set(e[k]) for k in ("predicates", "concepts", "attributes", "tokens")}
    if not any(hit.values()):
        return None
    parts = []
    for k, w in (("predicates", 0.5), ("concepts", 0.35)):
        if q[k]:
            parts.append((sum(q["idf"][k, t] for t in hit[k]) / sum(q["idf"][k, t] for t in q[k]), w))
    for k, w in (("attributes", 0.05), ("tokens", 0.1)):
        if q[k]:
            parts.append((len(hit[k]) / len(set(q[k])), w))
    rel = sum(v * w for v, w in parts) / sum(w for _, w in parts)
    bonus = 0.05 if hit["predicates"] and hit["concepts"] else 0.0
    score = min(1.0, 0.77 * rel + 0.1 * e["support"] + 0.08 * e["cover"] + bonus)
    return round(score, 6), round(rel, 6), hit


def groups(q, events, top_k=5, hops=2):
    """Ranked (event numbers, score, anchor) for one question over the ordered events of its recording."""
    n = len(events)
    idf = {}
    for k in ("predicates", "concepts"):
        for t in q[k]:
            idf[k, t] = math.log((n + 1) / (sum(t in e[k] for e in events) + 1)) + 1
    q = dict(q, idf=idf)
    seeds = [(s[0], i) for i, e in enumerate(events) if (s := event_score(q, e))]
    seeds.sort(key=lambda x: (-x[0], events[x[1]]["start"]))
    best = {}
    for score, seed in seeds[: max(4 * top_k, 20)]:
        lo = hi = seed
        for hop in range(hops):
            options = []
            for j, side in ((lo - 1, "after"), (hi + 1, "before")):
                if q["relation"] == side or not 0 <= j < n:
                    continue
                have = {k: set().union(*[events[i][k] for i in range(lo, hi + 1)]) for k in ("predicates", "concepts", "attributes", "tokens")}
                gain = sum(len(set(q[k]) & set(events[j][k]) - have[k]) for k in ("predicates", "concepts", "attributes"))
                words = len(set(q["tokens"]) & set(events[j]["tokens"]) - have["tokens"])
                options.append((-gain, -words, j))
            if not options:
                break
            gain, words, j = min(options)
            if gain == 0 and words == 0 and not (hop == 0 and q["relation"] in ("after", "before")):
                break
            lo, hi = min(lo, j), max(hi, j)
        if lo != hi:
            members = events[lo : hi + 1]
            pooled = {k: set().union(*[m[k] for m in members]) for k in ("predicates", "concepts", "attributes", "tokens")}
            pooled["support"] = sum(m["support"] for m in members) / len(members)
            pooled["cover"] = sum(m["cover"] for m in members) / len(members)
            base, rel, _ = event_score(q, pooled)
            gain = max(0.0, rel - max(s[1] for m in members if (s := event_score(q, m))))
            score = round(min(1.0, base + 0.08 * gain) - round(0.015 * (len(members) - 1), 6), 6)
        if (lo, hi) not in best or score > best[lo, hi][0]:
            best[lo, hi] = (score, seed)
    ranked = sorted(best.items(), key=lambda kv: (-kv[1][0], events[kv[0][0]]["start"], kv[0]))
    return [(lo, hi, score, seed) for (lo, hi), (score, seed) in ranked[:top_k]]
