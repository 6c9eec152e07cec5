"""Bokeh: a disc of light as a sum of complex separable kernels (Niemitalo's circular decomposition)."""

from __future__ import annotations

import numpy as np

from .base import border_index, window_of

# Fixed values: (a, b, A, B) of each component, by the number of components.
COMPONENTS = {
    1: ((0.862325, 1.624835, 0.767583, 1.862321),),
    2: ((0.886528, 5.268909, 0.411259, -0.548794), (1.960518, 1.558213, 0.513282, 4.56111)),
    3: ((2.17649, 5.043495, 1.621035, -2.105439), (1.019306, 9.027613, -0.28086, -0.162882), (2.81511, 1.597273, -0.366471, 10.300301)),
    4: ((4.338459, 1.553635, -5.767909, 46.164397), (3.839993, 4.693183, 9.795391, -15.227561), (2.791880, 8.178137, -3.048324, 0.302959), (1.342190, 12.328289, 0.010001, 0.244650)),
    5: ((4.892608, 1.685979, -22.356787, 85.91246), (4.71187, 4.998496, 35.918936, -28.875618), (4.052795, 8.244168, -13.212253, -1.578428), (2.929212, 11.900859, 0.507991, 1.816328), (1.512961, 16.116382, 0.138051, -0.01)),
    6: ((5.143778, 2.079813, -82.326596, 111.231024), (5.612426, 6.153387, 113.878661, 58.004879), (5.982921, 9.802895, 39.479083, -162.028887), (6.505167, 11.059237, -71.286026, 95.027069), (3.869579, 14.81052, 1.405746, -3.704914), (2.201904, 19.032909, -0.152784, -0.107988)),
}
SCALES = {1: 1.4, 2: 1.2, 3: 1.2, 4: 1.2, 5: 1.2, 6: 1.2}


def kernels(radius: int, components: int) -> list[tuple[np.ndarray, float, float]]:
    """(complex line, weight of the real part, of the imaginary one), normalised together."""
    x = (np.arange(-radius, radius + 1) * SCALES[components] / radius) ** 2
    lines = [(np.exp(-a * x) * np.exp(1j * b * x), p, q) for a, b, p, q in COMPONENTS[components]]
    total = sum(p * (s := np.outer(k, k).sum()).real + q * s.imag for k, p, q in lines)
    return [(k / np.sqrt(total), p, q) for k, p, q in lines]


def bokeh_blur(v, radius=32, components=2, gamma=3.0, rect=None):
    left, top, right, bottom = window_of(v, rect)
    part = v[top:bottom, left:right].copy()
    part[..., :3] = part[..., :3] ** gamma
    h, w = part.shape[:2]
    out = np.zeros_like(part)
    for line, p, q in kernels(radius, components):
        across = sum(k * part[:, border_index(np.arange(w) + d - radius, 0, w - 1)] for d, k in enumerate(line))
        both = sum(k * across[border_index(np.arange(h) + d - radius, 0, h - 1)] for d, k in enumerate(line))
        out += p * both.real + q * both.imag
    out = np.clip(out, 0, None)
    out[..., :3] = out[..., :3] ** (1 / gamma)
    done = v.copy()
    done[top:bottom, left:right] = np.clip(out, 0, 1)
    return done
