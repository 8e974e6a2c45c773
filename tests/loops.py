"""Plain loops that tests compare with: slow and obvious."""


def iou(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda r: max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1])
    union = area(a) + area(b) - w * h
    return w * h / union if union > 0 else 0.0


def suppress(boxes, scores, limit):
    order = sorted(range(len(boxes)), key=lambda i: (-scores[i], i))
    kept = []
    for i in order:
        if all(iou(boxes[k], boxes[i]) <= limit for k in kept):
            kept.append(i)
    return kept


def match(boxes, scores, truths, limit):
    used, hits = set(), {}
    for i in sorted(range(len(boxes)), key=lambda i: (-scores[i], i)):
        best, at = 0.0, None
        for g, t in enumerate(truths):
            if g not in used and iou(boxes[i], t) > best:
                best, at = iou(boxes[i], t), g
        hits[i] = at if at is not None and best >= limit else None
        if hits[i] is not None:
            used.add(hits[i])
    return hits


def average_precision(rows, n_truths):
    """rows: (score, image, index, hit)."""
    if not n_truths:
        return 0.0
    rows = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    tp, steps = 0, []
    for n, r in enumerate(rows, 1):
        tp += r[3]
        steps.append((tp / n_truths, tp / n))
    total, before = 0.0, 0.0
    for recall, _ in steps:
        if recall > before:
            total += (recall - before) * max(p for r, p in steps if r >= recall)
            before = recall
    return total


def capped_groups(hashes, threshold, cap):
    """hashes: name -> int; every pair in the order (distance, left, right)."""
    names = sorted(hashes)
    group = {n: n for n in names}
    pairs = sorted((bin((hashes[a] ^ hashes[b]) & (2**64 - 1)).count("1"), a, b) for i, a in enumerate(names) for b in names[i + 1 :])
    for d, a, b in pairs:
        if d > threshold:
            break
        ra, rb = group[a], group[b]
        if ra == rb:
            continue
        members = [n for n in names if group[n] in (ra, rb)]
        if cap is not None and len(members) > cap:
            continue
        for n in members:
            group[n] = min(ra, rb)
    return group
