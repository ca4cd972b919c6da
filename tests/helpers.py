"""Dense NumPy stand-ins used as brute force."""

import numpy as np

PIXELS = "image_id long, layer string, y int, x int, value int"


def pixel_rows(spark, masks):
    """Pixels of {(image_id, layer): 2-d array}."""
    rows = [
        (i, layer, int(y), int(x), int(v))
        for (i, layer), a in masks.items()
        for (y, x), v in np.ndenumerate(a)
    ]
    return spark.createDataFrame(rows, PIXELS)


def dense(pixels, shape, value="value"):
    """Pixels of one image as an array."""
    out = np.zeros(shape, int)
    for r in pixels.collect():
        out[r["y"], r["x"]] = r[value]
    return out


def flood(mask, connectivity=4):
    """Regions of equal positive value: {first pixel number: set of pixels}."""
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    seen, found = set(), {}
    for start in zip(*np.nonzero(mask)):
        if start in seen:
            continue
        todo, region = [start], set()
        seen.add(start)
        while todo:
            y, x = todo.pop()
            region.add((int(y), int(x)))
            for dy, dx in steps:
                n = (y + dy, x + dx)
                if 0 <= n[0] < mask.shape[0] and 0 <= n[1] < mask.shape[1] and n not in seen and mask[n] == mask[start]:
                    seen.add(n)
                    todo.append(n)
        y, x = min(region)
        found[(int(mask[start]), y * (1 << 24) + x)] = region
    return found
