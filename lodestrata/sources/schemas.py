"""Tables of a recorded session. seq is the order within a stream; every table is partitioned by session_id."""

from __future__ import annotations

POSES = "session_id string, seq long, t_arrival_us long, t_device_us long, px float, py float, pz float, qx float, qy float, qz float, qw float, fx float, fy float, cx float, cy float, tracking_state short"
LIDAR = "session_id string, seq long, t_arrival_us long, rev_id long, samples array<struct<angle_q6:int,dist_q2:int,quality:short>>"
FRAMES = "session_id string, seq long, t_arrival_us long, t_device_us long, width int, height int, jpeg binary"
DEPTH = "session_id string, seq long, t_arrival_us long, t_device_us long, width int, height int, fx float, fy float, cx float, cy float, depth_mm array<int>, confidence array<short>"
MESH = "session_id string, seq long, t_arrival_us long, t_device_us long, anchor_id string, transform array<double>, vertices array<float>, faces array<long>, classification array<short>"
MANIFEST = "session_id string, format_version int, notes string, git_commit string, device struct<name:string,os:string,capabilities:array<string>>, counts struct<poses:long,lidar:long,frames:long,depth:long,mesh:long,lidar_samples:long>, complete boolean"
MESSAGES = "seq long, type int, payload binary"
STREAMS = {"poses": POSES, "lidar": LIDAR, "frames": FRAMES, "depth": DEPTH, "mesh": MESH}
