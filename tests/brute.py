"""Plain NumPy answers for small inputs."""

import numpy as np


def distances(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))


def dbscan(x, eps, min_samples):
    """Rows in order; clusters grow one after the other from the first unassigned core row."""
    near = distances(x) <= eps
    core = near.sum(1) >= min_samples
    labels = np.full(len(x), -1)
    number = 0
    for start in range(len(x)):
        if core[start] and labels[start] == -1:
            stack = [start]
            labels[start] = number
            while stack:
                i = stack.pop()
                if not core[i]:
                    continue
                for j in np.flatnonzero(near[i]):
                    if labels[j] == -1:
                        labels[j] = number
                        stack.append(j)
            number += 1
    return labels


def silhouette(x, labels):
    d = distances(x)
    names = np.unique(labels)
    scores = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][labels == n].mean() for n in names if n != labels[i])
        scores.append(0.0 if max(a, b) == 0 else (b - a) / max(a, b))
    return float(np.mean(scores))


def calinski_harabasz(x, labels):
    names, n = np.unique(labels), len(x)
    between = sum((labels == c).sum() * ((x[labels == c].mean(0) - x.mean(0)) ** 2).sum() for c in names)
    within = sum(((x[labels == c] - x[labels == c].mean(0)) ** 2).sum() for c in names)
    return 1.0 if within == 0 else between * (n - len(names)) / (within * (len(names) - 1))


def davies_bouldin(x, labels):
    names = np.unique(labels)
    centers = np.array([x[labels == c].mean(0) for c in names])
    scatter = np.array([np.sqrt(((x[labels == c] - m) ** 2).sum(1)).mean() for c, m in zip(names, centers)])
    gap = distances(centers)
    gap[gap == 0] = np.inf  # itself, and clusters with the same center
    return float(((scatter[:, None] + scatter[None, :]) / gap).max(1).mean())


def ward(x, k):
    """Merge, over and over, the two groups whose union raises the within sum of squares least."""
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                a, b = x[groups[i]], x[groups[j]]
                rise = len(a) * len(b) / (len(a) + len(b)) * ((a.mean(0) - b.mean(0)) ** 2).sum()
                if best is None or rise < best[0]:
                    best = (rise, i, j)
        _, i, j = best
        groups[i] += groups.pop(j)
    labels = np.zeros(len(x), int)
    for number, g in enumerate(groups):
        labels[g] = number
    return labels


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))
