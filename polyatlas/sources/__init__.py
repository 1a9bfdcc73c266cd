"""Readers of external file formats."""

from .files import read_assembly_report, read_bed_fragments, read_coo

__all__ = ["read_assembly_report", "read_bed_fragments", "read_coo"]
