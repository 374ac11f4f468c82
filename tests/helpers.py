"""Brute-force definitions over plain Python rows, and random event logs."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from logwarden.config import Settings

# every size limit is tiny, so all the paths for large data are taken
TINY = Settings(
    broadcast_rows=0, heavy_key_rows=3, chunk_hours=1, piece_lines=2, models_rows_per_task=2
)


def lines_of(df):
    return sorted(r["line_number"] for r in df.select("line_number").collect())


def random_log(n, seed, minutes=240, users=("a", "b", "c", "unknown"), ips=("10.0.0.1", "10.0.9.2", "172.16.0.3", None)):
    """Many ties, a user with about half of all rows, missing values."""
    rng = random.Random(seed)
    base = datetime(2026, 7, 14, 22, 0)
    rows = []
    for _ in range(n):
        at = base + timedelta(seconds=rng.randrange(minutes * 60) // 20 * 20)
        user = "a" if rng.random() < 0.4 else rng.choice(users)
        ip = rng.choice(ips)
        verb = rng.choice(["Failed password", "Failed password", "Accepted password", "session opened"])
        rows.append((at.isoformat() if rng.random() > 0.02 else None, user, ip, f"{verb} for {user}"))
    return rows


def parsed_rows(rows):
    return [
        (i, datetime.fromisoformat(ts) if ts else None, user, ip, message.lower())
        for i, (ts, user, ip, message) in enumerate(rows, start=1)
    ]


def travel_pairwise(rows, minutes=60):
    hits, last = [], {}
    logins = [r for r in parsed_rows(rows) if "accepted password" in r[4] and r[3] and r[1]]
    for line, ts, user, ip, _ in sorted(logins, key=lambda r: (r[2], r[1], r[0])):
        net = ip.split(".")[:2]
        if user in last and ts - last[user][0] <= timedelta(minutes=minutes) and net != last[user][1]:
            hits.append(line)
        last[user] = (ts, net)
    return sorted(hits)


def brute_force_pairwise(rows, minutes=5, least=3):
    w = timedelta(minutes=minutes)
    every = [r for r in parsed_rows(rows) if r[1]]
    hits = set()
    for user in {r[2] for r in every}:
        failed = sorted((r[1], r[0]) for r in every if r[2] == user and "failed password" in r[4])
        good = [(r[1], r[0]) for r in every if r[2] == user and "accepted password" in r[4]]
        for i, (start, _) in enumerate(failed):
            span = [f for f in failed[i:] if f[0] - start <= w]
            if len(span) >= least:
                end = span[-1][0]
                hits |= {line for _, line in span}
                hits |= {line for ts, line in good if end <= ts <= end + w}
    return sorted(hits)


def enumeration_pairwise(rows, minutes=10, least=3):
    w = timedelta(minutes=minutes)
    every = [r for r in parsed_rows(rows) if r[1] and r[3] and "failed password" in r[4]]
    hits = set()
    for ip in {r[3] for r in every}:
        failed = sorted((r[1], r[0], r[2]) for r in every if r[3] == ip)
        for i, (start, _, _) in enumerate(failed):
            span = [f for f in failed[i:] if f[0] - start <= w]
            if len({f[2] for f in span}) >= least:
                hits |= {f[1] for f in span}
    return sorted(hits)


def incidents_pairwise(rows, minutes=30, by_ip=True):
    """{line: incident id} by linking every near pair that shares an identity."""
    w = timedelta(minutes=minutes)
    real = [
        (ts, line, None if user == "unknown" else user, ip if by_ip else None)
        for line, ts, user, ip, _ in parsed_rows(rows) if ts
    ]
    real.sort()
    label = list(range(len(real)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(real):
            for j in range(i):
                b = real[j]
                near = a[0] - b[0] <= w
                same = (a[2] and a[2] == b[2]) or (a[3] and a[3] == b[3])
                if near and same and label[i] != label[j]:
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
                    changed = True
    order = {c: i for i, c in enumerate(dict.fromkeys(label))}
    return {real[i][1]: order[label[i]] for i in range(len(real))}
