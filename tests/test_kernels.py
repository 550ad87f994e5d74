"""Kernels against identities and known answers."""

import numpy as np
import pytest

from hexaphase import model
from hexaphase.kernels import calibrate, noise, recursions, scan, special, track
from hexaphase.sources import hotmap
from hexaphase.sources.synthetic import directional


def test_exp1_against_quadrature():
    for x in (1e-6, 0.1, 0.9, 1.0, 1.1, 3.0, 20.0):
        u = np.linspace(np.log(x), np.log(x + 60), 400_001)
        want = np.trapezoid(np.exp(-np.exp(u)), u)  # of e**-t / t over t = e**u
        assert special.exp1(np.array([x]))[0] == pytest.approx(want, rel=1e-6)


def test_circular_peaks():
    y = np.zeros(360)
    y[[0, 100]], y[200:203] = (1.0, 0.04), 0.5
    assert special.circular_peaks(y, 0.05).tolist() == [0, 201]


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    c = rng.random((3, 4))
    best = special.best_assignment(c)
    assert len({j for _, j in best}) == 3
    from itertools import permutations

    assert sum(c[i, j] for i, j in best) == pytest.approx(min(sum(c[i, p[i]] for i in range(3)) for p in permutations(range(4), 3)))
    assert special.best_assignment(c.T) == sorted((j, i) for i, j in best)


def test_bandpass_passes_the_band():
    s = special.bandpass(200, 10_000, 48_000)
    f = np.array([20.0, 200.0, 1_000.0, 10_000.0, 20_000.0])
    z = np.exp(-2j * np.pi * f / 48_000)
    h = np.prod([np.polyval(b[::-1], z) / np.polyval(a[::-1], z) for b, a in s], axis=0)
    assert np.abs(h) == pytest.approx([0, 2**-0.5, 1, 2**-0.5, 0], abs=2e-3)


@pytest.mark.parametrize("theta", [0, 1, 73, 180, 359])
def test_music_finds_the_direction(theta):
    spec, _ = scan.spectra(directional((theta,), seed=3, samples=16_320, peak=1.0))
    outer = np.einsum("tbi,tbj->tbij", spec, spec.conj())
    y = scan.normalized(scan.music(outer[-19:].mean(axis=0)[None], 1))[0]
    assert abs(track.turn(float(y.argmax()), theta)) <= 2
    assert len(scan.pick(y, 1)) == 1


def test_music_separates_two():
    spec, _ = scan.spectra(directional((30, 210), seed=49, samples=16_320, peak=1.0))
    outer = np.einsum("tbi,tbj->tbij", spec, spec.conj())
    y = scan.normalized(scan.music(outer[-19:].mean(axis=0)[None], 2))[0]
    got = scan.pick(y, 2, model.ScanConfig(threshold=0.15))
    assert len(got) == 2 and abs(track.turn(got[0], got[1])) >= 50


def count(audio):
    spec, power = scan.spectra(audio[:7_680])
    return scan.count_sources(scan.cross(spec), power)


def test_counts():
    assert count(np.zeros((7_680, 8))) == 0
    assert count(directional((70,), samples=18_000)) == 1
    assert count(directional((30, 210), (1.0, 0.45), samples=18_000)) == 2
    assert count(0.15 * np.random.default_rng(91).normal(size=(7_680, 8))) == 0
    near = [count(directional(a, (1.0, b), samples=18_000)) for a, b in (((20, 50), 0.45), ((0, 30), 0.70))]
    assert near == [1, 1]
    first, second = directional((30,), samples=18_000), directional((210,), samples=18_000)
    assert count(np.concatenate([first[:4_800], second[4_800:]])) == 1


def test_gate_weights():
    w = model.gate_weights(np.arange(201) * 50.0)
    assert w.sum() == pytest.approx(1) and np.count_nonzero(w) == 64


def test_noise_tracker_hears_a_tone_and_warms_up():
    rng, t = np.random.default_rng(0), noise.NoiseTracker()
    for i in range(120):
        e = t(rng.normal(0, 0.01, (960, 8)).astype(np.float32))
        assert e.ready == (i >= 49) and (e.p2 is None) == (i < 49)
    tone = 0.5 * np.sin(2 * np.pi * 1_000 * np.arange(960) / 48_000)
    e = t((rng.normal(0, 0.01, (960, 8)) + tone[:, None]).astype(np.float32))
    assert (e.presence[:, 20] > 0.99).all()


def test_denoiser_is_transparent_while_warming_up():
    rng, d = np.random.default_rng(2), noise.Denoiser()
    blocks = [rng.normal(0, 0.1, (960, 8)).astype(np.float32) for _ in range(4)]
    out = [d(b, None) for b in blocks] + [d.flush()]
    assert out[0] is None
    for a, b in zip(blocks, out[1:], strict=True):
        assert np.abs(a - b).max() < 2e-7


TEST = model.TrackerConfig(association_gate_deg=45.0, confirmation_observations=3, confirmation_window_samples=9_600)


def run(steps, cfg=TEST, births=True):
    s, out = track.Stream(), []
    for now, angles in steps:
        out.append(track.update(s, 0, now, [(float(a), 0.9, 0.9) for a in angles], births, c=cfg))
    return out


def seen(rows):
    return {round(r["measured_theta"]): r["track_id"] for r in rows if r["measured_theta"] is not None}


def test_tracks_cross_zero_and_swap_rank():
    a, b, c = run([(15_360, (358, 120)), (16_320, (121, 359)), (17_280, (1, 122))])
    assert seen(a)[358] == seen(b)[359] == seen(c)[1] and seen(a)[120] == seen(b)[121] == seen(c)[122]
    assert all(r["state"] == "confirmed" for r in c)


def test_track_life_cycle():
    out = run([(960, (30,)), (1_920, (30.5,)), (2_880, (31,)), (3_840, ()), (4_800, (32,)), (4_800 + 96_001, ())])
    states = [[r["state"] for r in x] for x in out]
    assert states == [["tentative"], ["tentative"], ["confirmed"], ["coasting"], ["confirmed"], []]
    assert len({r["track_id"] for x in out for r in x}) == 1


def test_at_most_four_tracks():
    assert all(len(x) <= 4 for x in run([(960, (0, 60, 120)), (1_920, (180, 240, 300)), (2_880, (30, 90, 150))]))


STRICT = model.TrackerConfig(association_chi2=0.01, minimum_association_probability=0.99)


def test_rescue_keeps_the_id():
    out = run([(960, (10,)), (1_920, (10,)), (2_880, (10,)), (3_840, (50,))], STRICT)
    assert len({r["track_id"] for x in out for r in x}) == 1 and 10 < out[-1][0]["theta"] < 50
    assert len(run([(960, (10,)), (1_920, (61,))], STRICT)[-1]) == 2


def test_epoch_clears_tracks_but_not_ids():
    s = track.Stream()
    a = track.update(s, 0, 960, [(10.0, 0.9, 0.9)])
    b = track.update(s, 1, 960, [(10.0, 0.9, 0.9)])
    assert a[0]["track_id"] == 1 and b[0]["track_id"] == 2
    with pytest.raises(ValueError):
        track.update(s, 1, 960, [])


def test_rate_controller():
    assert recursions.rate_step(None, 21, 0) == (40, 0)
    assert recursions.rate_step((40, 0), 0, 24)[0] == 40
    assert recursions.rate_step((40, 0), 0, 41) == (60, 0)
    cfg = model.RateConfig(stable_ms=80)
    state = recursions.rate_step((60, 0), 0, 25, cfg)
    assert state == (60, 60) and recursions.rate_step(state, 0, 25, cfg) == (40, 0)
    assert recursions.rate_step((200, 0), 99, 0)[0] == 200


def test_minimum_against_brute_force():
    rng = np.random.default_rng(4)
    x, m = rng.random(200), recursions.RunningMinimum(5, 10)
    got = [m(v) for v in x]
    # after each closed sub-window: the least of the last ten sub-windows' least values; a sub-window holds its five values and the one before
    parts = [x[max(0, 5 * k - 1) : 5 * k + 5].min() for k in range(40)]
    for k in range(40):
        assert got[5 * k + 4] == pytest.approx(min(parts[max(0, k - 9) : k + 1]))


def test_calibration_finds_gain_delay_and_sign():
    one, gap, rng = calibrate.chirp(), np.zeros(16_800), np.random.default_rng(3)
    line = np.concatenate([gap, np.tile(np.concatenate([0.5 * one, gap]), 4), gap])
    sound = np.column_stack([line] * 7) + 1e-4 * rng.normal(size=(len(line), 7))
    sound[:, 2] = np.roll(sound[:, 2], 3) * -0.5
    r = calibrate.analyze(sound, one, chirps=4)
    assert r["delay"] == [3, 3, 0, 3, 3, 3, 3] and r["polarity"] == [1, 1, -1, 1, 1, 1, 1] and r["gain"][2] / r["gain"][0] == pytest.approx(2, rel=0.01)
    for sign in (1, -1):
        x = rng.normal(size=4_000)
        assert calibrate.lag_correlation(sign * np.concatenate([np.zeros(3), x[:-3]]), x)[0] == 3


def test_stimulus():
    s = calibrate.stimulus()
    assert len(s) == 41 * 48_000 - round(2 * 48_000) + 2 * 48_000 and 20 * np.log10(np.sqrt(np.mean(s[3 * 48_000 : 23 * 48_000].astype(float) ** 2))) == pytest.approx(-18, abs=0.01)


def test_hotmap_frames_over_piece_borders():
    frame = lambda v: hotmap.LEAD + bytes([v]) * 256
    data = b"xx" + frame(1) + frame(2) + b"\xff" * 7
    for cut in (0, 5, 17, 100, 280, len(data)):
        a, rest = hotmap.frames(data[:cut])
        b, rest = hotmap.frames(data[cut:], rest)
        assert [f[0] for f in a + b] == [1, 2]
    assert hotmap.command(beam=10) == b"A" and hotmap.command(light=False) == b"e"


def test_configuration_is_strict():
    with pytest.raises(ValueError):
        model.ProjectConfig.load({"nonsense": 1})
    with pytest.raises(TypeError):
        model.ProjectConfig.load({"tracker": {"nonsense": 1}})
    assert model.ProjectConfig.load({}).identity() == model.ProjectConfig().identity()
