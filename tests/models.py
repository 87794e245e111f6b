"""Plain sequential models to compare with."""

import numpy as np

RADIUS = 6371000.0


def distances(lat, lon, lats, lons):
    p1, p2 = np.radians(lat), np.radians(lats)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin((np.radians(lons) - np.radians(lon)) / 2) ** 2
    return 2 * RADIUS * np.arcsin(np.sqrt(a))


def neighbor_sets(lats, lons, radius):
    return [np.flatnonzero(distances(a, o, lats, lons) <= radius) for a, o in zip(lats, lons)]


def dbscan(lats, lons, radius, needed):
    """Labels by expanding one cluster after the other in row order."""
    near = neighbor_sets(lats, lons, radius)
    core = [len(n) >= needed for n in near]
    labels, next_label = np.full(len(lats), -1), 0
    for start in range(len(lats)):
        if not core[start] or labels[start] >= 0:
            continue
        stack = [start]
        labels[start] = next_label
        while stack:
            for other in near[stack.pop()]:
                if labels[other] < 0:
                    labels[other] = next_label
                    if core[other]:
                        stack.append(other)
        next_label += 1
    return labels


def adaptive(lats, lons, radius, needed):
    """(labels, radii) of the greedy loop over sampled centres."""
    centres = []
    for i in range(0, len(lats), 10):
        tolerance = radius / (111320 * np.cos(np.radians(lats[i])))
        ball = np.flatnonzero((lats - lats[i]) ** 2 + (lons - lons[i]) ** 2 <= tolerance**2)
        if len(ball) > 1:
            near = ball[distances(lats[i], lons[i], lats[ball], lons[ball]) <= radius]
            if len(near) >= needed:
                centres.append((-len(near), i, near))
    labels, radii = np.full(len(lats), -1), []
    for _, _, near in sorted(centres, key=lambda c: c[:2]):
        free = near[labels[near] < 0]
        if len(free) < needed:
            continue
        away = distances(lats[free].mean(), lons[free].mean(), lats[free], lons[free])
        fitted = max(100.0, min(np.percentile(away, 80), radius * 0.6))
        kept = free[away <= fitted]
        if len(kept) >= needed:
            labels[kept] = len(radii)
            radii.append(fitted)
    return labels, radii
