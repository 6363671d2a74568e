"""Small parts merged one at a time, against which merging in rounds is held."""

import heapq


def merge_small(parts: list[dict], borders: list[tuple], features: list[str], least_cells: int, least_area: float, most_distance: float = float("inf")) -> dict:
    """Where each part ends up when small ones join the neighbour most like them, smallest first.

    parts: id, n_cells, area and features of every part; borders: pairs of ids that touch. Each merge depends on those
    before, so they come smallest first off a heap. Ties: the
    larger neighbour, then the lower id. A part without a neighbour within the distance stays.
    """
    own = {p["id"]: dict(p) for p in parts}
    touch: dict = {i: set() for i in own}
    for a, b in borders:
        touch[a].add(b)
        touch[b].add(a)
    into, heap = {i: i for i in own}, [(p["n_cells"], p["id"]) for p in own.values()]
    heapq.heapify(heap)
    while heap:
        n, i = heapq.heappop(heap)
        p = own.get(i)
        if p is None or p["n_cells"] != n or not (p["n_cells"] < least_cells or p["area"] < least_area):
            continue  # merged since, or large enough
        near = [(sum((p[f] - own[n][f]) ** 2 for f in features) ** 0.5, -own[n]["n_cells"], n) for n in touch[p["id"]]]
        near = [x for x in near if x[0] <= most_distance]
        if not near:
            continue
        q = own[min(near)[2]]
        total = p["n_cells"] + q["n_cells"]
        for f in features:
            q[f] = (q[f] * q["n_cells"] + p[f] * p["n_cells"]) / total
        q["n_cells"], q["area"] = total, q["area"] + p["area"]
        for n in touch.pop(p["id"]):
            touch[n].discard(p["id"])
            if n != q["id"]:
                touch[n].add(q["id"])
                touch[q["id"]].add(n)
        touch[q["id"]].discard(q["id"])
        own.pop(p["id"])
        into[p["id"]] = q["id"]
        heapq.heappush(heap, (total, q["id"]))
    for i in into:  # follow merges of merges to their end
        end = i
        while into[end] != end:
            end = into[end]
        while into[i] != end:
            into[i], i = end, into[i]
    return into
