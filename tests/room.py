"""A synthetic recording: a sensor walks twice round a circle in a box room whose walls are 4 m and 5 m apart."""

import math

import numpy as np

WIDTH, DEPTH, HEIGHT = 4.0, 5.0, 1.2
RVEC, TVEC = (-math.pi / 2, 0.0, 0.0), (0.0, 0.0, 0.0)
START, OFFSET = 1_000_000_000, 7_000_000


def pose(t):
    a = 2 * math.pi * t / 7.0
    return 0.8 * math.cos(a), HEIGHT, 0.8 * math.sin(a), 0.4 * math.sin(2 * a)


def quaternion(yaw):
    return 0.0, math.sin(yaw / 2), 0.0, math.cos(yaw / 2)


def wall_distance(x, z, dx, dz):
    far = [((WIDTH / 2 if dx > 0 else -WIDTH / 2) - x) / dx if abs(dx) > 1e-12 else math.inf, ((DEPTH / 2 if dz > 0 else -DEPTH / 2) - z) / dz if abs(dz) > 1e-12 else math.inf]
    return min(far)


def poses(seconds=14, drift=0.0, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(int(seconds * 60)):
        t = k / 60
        x, y, z, yaw = pose(t)
        device = START + int(t * 1e6)
        q = quaternion(yaw)
        out.append(("s1", k, device + OFFSET + int(abs(rng.normal(0, 400))), device, x + drift * t, y, z, *q, 60.0, 55.0, 31.5, 23.5, 2))
    return out


def lidar(seconds=14, samples=120, turn=0.0):
    out, period = [], 0.1
    for k in range(1, int(seconds / period)):
        end = k * period
        found = []
        for i in range(samples):
            t = end - period * (1 - i / (samples - 1))
            x, _, z, yaw = pose(max(t, 0))
            a = 2 * math.pi * i / samples
            lx, lz = math.cos(a), -math.sin(a)  # in the body's horizontal plane
            dx, dz = math.cos(yaw) * lx + math.sin(yaw) * lz, -math.sin(yaw) * lx + math.cos(yaw) * lz
            found.append((int(round(math.degrees(a) * 64)) & 0xFFFF, int(round(wall_distance(x, z, dx, dz) * 4000)) & 0xFFFF, 15))
        out.append(("s1", k - 1, START + OFFSET + int(end * 1e6), k, found))
    return out
