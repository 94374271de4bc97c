"""Volumes that are mounted on a machine: what a binding of roots compares with the catalogue."""

from __future__ import annotations

import os
import stat

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "mount string, device string, fs_type string, volume_guid string, capacity_bytes long, free_bytes long, cluster_bytes long"
#: Kernel file systems hold no catalogue.
VIRTUAL = {"proc", "sysfs", "tmpfs", "devtmpfs", "devpts", "cgroup", "cgroup2", "mqueue", "debugfs", "tracefs", "securityfs", "pstore", "bpf", "autofs", "hugetlbfs", "configfs", "fusectl"}


def uuids(folder: str = "/dev/disk/by-uuid") -> dict[str, str]:
    """Device path to file-system UUID."""
    try:
        return {os.path.realpath(os.path.join(folder, n)): n for n in os.listdir(folder)}
    except OSError:
        return {}


def mounted(table: str = "/proc/self/mounts") -> list[tuple]:
    known, out = uuids(), []
    with open(table) as f:
        for line in f:
            device, mount, kind = [x.encode().decode("unicode_escape") for x in line.split()[:3]]
            if kind in VIRTUAL:
                continue
            try:
                v, s = os.statvfs(mount), os.stat(mount)
            except OSError:
                continue
            if stat.S_ISDIR(s.st_mode):
                guid = known.get(os.path.realpath(device)) or f"dev-{s.st_dev}"
                out.append((mount, device, kind, guid, v.f_blocks * v.f_frsize, v.f_bavail * v.f_frsize, v.f_frsize))
    return out


def mounted_volumes(spark: SparkSession) -> DataFrame:
    """The driver's mounts; run it where the drives are."""
    return spark.createDataFrame(mounted(), SCHEMA)


def volume_guid_of(path: str, mounts: list[tuple] | None = None) -> str | None:
    """The volume that a path lies on: that of the longest mount above it."""
    path = os.path.realpath(path)
    above = [m for m in (mounted() if mounts is None else mounts) if os.path.commonpath([m[0], path]) == m[0]]
    return max(above, key=lambda m: len(m[0]))[3] if above else None


def system_volume_guid(mounts: list[tuple] | None = None) -> str | None:
    return volume_guid_of("/", mounts)


DISK_SCHEMA = "device string, serial string, model string, media string, capacity_bytes long"


def disks(folder: str = "/sys/block") -> list[tuple]:
    """Disks of a machine as its kernel describes them: serial and model, rotating or not, size; unknown is null."""

    def said(disk: str, *names: str) -> str | None:
        for name in names:
            try:
                with open(os.path.join(folder, disk, name)) as f:
                    if value := f.read().strip():
                        return value
            except OSError:
                continue
        return None

    out = []
    for disk in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        sectors, rotating, removable = said(disk, "size"), said(disk, "queue/rotational"), said(disk, "removable")
        if disk.startswith(("loop", "ram", "zram", "dm-")) or not sectors or not int(sectors):
            continue
        media = {"1": "hdd", "0": "flash" if removable == "1" else "ssd"}.get(rotating or "")
        out.append((f"/dev/{disk}", said(disk, "device/serial", "serial"), said(disk, "device/model"), "optical" if disk.startswith("sr") else media, int(sectors) * 512))
    return out


def disk_table(spark: SparkSession, folder: str = "/sys/block") -> DataFrame:
    """The driver's disks; with ``Catalog.discover`` they are merged by serial."""
    return spark.createDataFrame(disks(folder), DISK_SCHEMA)
