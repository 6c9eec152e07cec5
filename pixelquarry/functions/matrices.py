"""Colour matrices. Rows are what red, green, blue, alpha and one add to (red, green, blue, alpha)."""

from __future__ import annotations

import math

import numpy as np

# The well-known filters' coefficients.
ACHROMATOMALY = ((0.618, 0.163, 0.163), (0.320, 0.775, 0.320), (0.062, 0.062, 0.516))
ACHROMATOPSIA = ((0.299, 0.299, 0.299), (0.587, 0.587, 0.587), (0.114, 0.114, 0.114))
DEUTERANOMALY = ((0.8, 0.258, 0), (0.2, 0.742, 0.142), (0, 0, 0.858))
DEUTERANOPIA = ((0.625, 0.7, 0), (0.375, 0.3, 0.3), (0, 0, 0.7))
PROTANOMALY = ((0.817, 0.333, 0), (0.183, 0.667, 0.125), (0, 0, 0.875))
PROTANOPIA = ((0.567, 0.558, 0), (0.433, 0.442, 0.242), (0, 0, 0.758))
TRITANOMALY = ((0.967, 0, 0), (0.33, 0.733, 0.183), (0, 0.267, 0.817))
TRITANOPIA = ((0.95, 0, 0), (0.05, 0.433, 0.475), (0, 0.567, 0.525))
BLACK_WHITE = ((1.5, 1.5, 1.5), (1.5, 1.5, 1.5), (1.5, 1.5, 1.5))
KODACHROME = ((0.7297023, 0, 0), (0, 0.6109577, 0), (0, 0, 0.597218))
LOMOGRAPH = ((1.5, 0, 0), (0, 1.45, 0), (0, 0, 1.16))
POLAROID = ((1.538, -0.062, -0.262), (-0.022, 1.578, -0.022), (0.216, -0.16, 1.5831))
KODACHROME_ADDS, LOMOGRAPH_ADDS, POLAROID_ADDS = (0.105, 0.145, 0.155), (-0.1, -0.02, -0.07), (0.02, -0.05, -0.05)
BT709, BT601 = (0.2126, 0.7152, 0.0722), (0.299, 0.587, 0.114)
SATURATION_WEIGHTS = (0.213, 0.715, 0.072)
SEPIA = ((0.393, 0.349, 0.272), (0.769, 0.686, 0.534), (0.189, 0.168, 0.131))
HUE_SINE = ((-0.213, 0.143, -0.787), (-0.715, 0.140, 0.715), (0.928, -0.283, 0.072))


def matrix(rgb, adds=(0, 0, 0), alpha: float = 1) -> np.ndarray:
    """5x4 from its 3x3 part."""
    m = np.zeros((5, 4))
    m[:3, :3], m[3, 3], m[4, :3] = rgb, alpha, adds
    return m


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """First a, then b."""
    whole = np.eye(5)
    whole[:, :4] = b
    first = np.eye(5)
    first[:, :4] = a
    return (first @ whole)[:, :4]


def _toward_identity(weights: np.ndarray, amount: float) -> np.ndarray:
    """Columns of weights at amount 0, the identity at 1; blue's row is what is left of one."""
    m = weights + (np.eye(3) - weights) * amount
    m[2] = 1 - (m[0] + m[1])
    return m


def brightness(amount: float) -> np.ndarray:
    return matrix(np.eye(3) * amount)


def contrast(amount: float) -> np.ndarray:
    return matrix(np.eye(3) * amount, (0.5 - 0.5 * amount,) * 3)


def grayscale_bt709(amount: float = 1) -> np.ndarray:
    return matrix(_toward_identity(np.repeat(np.array(BT709)[:, None], 3, 1), 1 - amount))


def grayscale_bt601(amount: float = 1) -> np.ndarray:
    """Green's own weight grows by 0.2848 with the amount that is kept, as in the BT.709 filter."""
    keep = 1 - amount
    m = _toward_identity(np.repeat(np.array(BT601)[:, None], 3, 1), keep)
    m[1, 1] = 0.587 + 0.2848 * keep
    m[2, 1] = 1 - (m[0, 1] + m[1, 1])
    return matrix(m)


def saturate(amount: float) -> np.ndarray:
    return matrix(_toward_identity(np.repeat(np.array(SATURATION_WEIGHTS)[:, None], 3, 1), amount))


def hue(degrees: float) -> np.ndarray:
    c, s = math.cos(math.radians(degrees % 360)), math.sin(math.radians(degrees % 360))
    w = np.repeat(np.array(SATURATION_WEIGHTS)[:, None], 3, 1)
    return matrix(w + c * (np.eye(3) - w) + s * np.array(HUE_SINE))


def invert(amount: float = 1) -> np.ndarray:
    return matrix(np.eye(3) * (1 - 2 * amount), (amount,) * 3)


def opacity(amount: float) -> np.ndarray:
    return matrix(np.eye(3), alpha=amount)


def lightness(amount: float) -> np.ndarray:
    return matrix(np.eye(3), (amount - 1,) * 3)


def sepia(amount: float = 1) -> np.ndarray:
    return matrix(np.array(SEPIA) + (np.eye(3) - np.array(SEPIA)) * (1 - amount))


def kodachrome() -> np.ndarray:
    return multiply(multiply(matrix(KODACHROME, KODACHROME_ADDS), saturate(1.2)), contrast(1.35))


def lomograph() -> np.ndarray:
    return multiply(multiply(matrix(LOMOGRAPH, LOMOGRAPH_ADDS), saturate(1.1)), contrast(1.33))


def polaroid() -> np.ndarray:
    return matrix(POLAROID, POLAROID_ADDS)


def black_white() -> np.ndarray:
    return matrix(BLACK_WHITE, (-1, -1, -1))


COLOR_BLINDNESS = {
    "achromatomaly": ACHROMATOMALY,
    "achromatopsia": ACHROMATOPSIA,
    "deuteranomaly": DEUTERANOMALY,
    "deuteranopia": DEUTERANOPIA,
    "protanomaly": PROTANOMALY,
    "protanopia": PROTANOPIA,
    "tritanomaly": TRITANOMALY,
    "tritanopia": TRITANOPIA,
}
