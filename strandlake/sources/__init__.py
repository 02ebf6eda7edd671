"""Reading tables and text formats."""

from .fhir import fhir_records, fhir_table
from .signals import signal_files, signal_slices
from .tables import table
from .text_formats import bed_positions, vcf_calls

__all__ = ["bed_positions", "fhir_records", "fhir_table", "signal_files", "signal_slices", "table", "vcf_calls"]
