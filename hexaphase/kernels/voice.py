"""Weights of frequency bins by the long-term average spectrum of voices, half male and half female."""

from __future__ import annotations

import numpy as np

# Fixed values (Byrne et al., JASA 96(4), 1994, table II): third-octave centres in Hz, male and female levels in dB.
CENTRES = (63, 80, 100, 125, 160, 200, 250, 315, 400, 500, 630, 800, 1000, 1250, 1600, 2000, 2500, 3150, 4000, 5000, 6300, 8000)
MALE = (38.6, 43.5, 54.4, 57.7, 56.8, 58.2, 59.7, 60.0, 62.4, 62.6, 60.6, 55.7, 53.1, 53.7, 52.3, 48.7, 48.9, 47.0, 46.0, 44.4, 43.3, 42.4)
FEMALE = (37.0, 36.0, 37.5, 40.1, 53.4, 62.2, 60.9, 58.1, 61.7, 61.7, 60.4, 58.0, 54.3, 52.3, 51.7, 48.8, 47.3, 46.7, 45.3, 44.6, 45.2, 44.9)
GRID_STEP, TOP = 5.0, 8000.0


def curve(levels: tuple[float, ...], freqs: np.ndarray) -> np.ndarray:
    """Density at freqs: levels over band widths, straight lines on log axes, linear to zero below the lowest centre; of unit area to 8 kHz."""
    centre = np.array(CENTRES, np.float64)
    density = 10 ** (0.1 * (np.array(levels) - max(levels))) / (centre * (2 ** (1 / 6) - 2 ** (-1 / 6)))

    def at(f: np.ndarray) -> np.ndarray:
        logs = np.exp(np.interp(np.log(np.maximum(f, centre[0])), np.log(centre), np.log(density)))
        return np.where(f < centre[0], density[0] * f / centre[0], logs)

    grid = np.arange(0, TOP + GRID_STEP, GRID_STEP)
    own = at(grid)
    return np.interp(freqs, grid, own / np.trapezoid(own, grid))


def weights(freqs: np.ndarray) -> np.ndarray:
    """Of bins above 0 and up to 8 kHz; their sum is one."""
    f = np.asarray(freqs, np.float64)
    if f.ndim != 1 or not f.size or not np.isfinite(f).all() or (f <= 0).any() or (f > TOP).any():
        raise ValueError("frequencies must lie above 0 and up to 8000 Hz")
    mean = (curve(MALE, f) + curve(FEMALE, f)) / 2
    return mean / mean.sum()
