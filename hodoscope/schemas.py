"""Explicit schemas of every table the engine reads or writes. Missing values are NULL, never a sentinel."""

from __future__ import annotations

from pyspark.sql.types import StructType, _parse_datatype_string


def _schema(text: str) -> StructType:
    return _parse_datatype_string(text)


#: Readout of one channel in one event.
RAW_HITS = "entry long, det int, plane int, id0 int, id1 int, chip int, channel int, raw_idx int, adc array<short>, adc_value double, hit_time_ns double"
CHANNEL_HITS = "entry long, det int, plane int, id0 int, id1 int, raw_idx int, amp double, charge double, peak_time double, time double, rise_time double, width double, time_error double, is_saturated boolean, is_valid boolean"
CLUSTERS = "entry long, det int, plane int, cluster_idx int, size int, range int, charge double, max_amp double, time double, centroid double, pos double, local_x double, local_y double"
LOCAL_HITS = "entry long, det int, hit_idx int, x double, y double, z double, cluster_indices array<int>"
TRACKS = "entry long, raw_event_id long, track_index int, kx double, ky double, bx double, by double, chi2 double, t0 double, has_t0 boolean"
TRACKER_VALIDATION = "entry long, raw_event_id long, track_index int, det int, res_x double, res_y double, hit_x double, hit_y double, cluster_indices array<int>"
DUT_ROWS = "entry long, det int, pred_x double, pred_y double, res_x double, res_y double, hit_x double, hit_y double, hit_flag int, cluster_x int, cluster_y int"
PAD_DUT_ROWS = "entry long, det int, pred_x double, pred_y double, hit_x double, hit_y double, res_x double, res_y double, hit_flag int, cluster_idx int"
EFFICIENCY_SUMMARY = "det int, margin double, total_events long, valid_bins long, efficiency_x double, efficiency_y double, efficiency_2d double, low_x double, high_x double, low_y double, high_y double, low_2d double, high_2d double, nonuniformity_x double, nonuniformity_y double, nonuniformity_2d double"
SCOPE_EVENTS = "event_id long, event_id_time double, reference_time double, c1_time double, c2_time double, c3_time double, c1_amp double, c2_amp double, c3_amp double"
TIMING_RESULTS = "analysis string, object string, detector_a int, detector_b int, entries long, mean double, sigma double, sigma_error double, resolution double, numerator long, denominator long, efficiency double, window_start double, window_end double, amplitude_corrected boolean"
AMPLITUDE_CORRECTIONS = "source string, det int, entries long, amp_low double, amp_high double, parameter array<double>"

#: Canonical event tables by schema version; version 1 is what the binary decoder writes and the reader refuses.
EVENTS_V1 = "entry long, event_id long, timestamp long, detector_id array<int>, plane_type array<int>, strip_id array<int>, board_id array<int>, chip_id array<int>, channel_id array<int>, waveform array<array<short>>, channel_flags array<long>"
EVENTS_V2 = "entry long, event_id long, timestamp long, detector_id array<int>, plane_type array<int>, id0 array<int>, id1 array<int>, board_id array<int>, chip_id array<int>, channel_id array<int>, waveform array<array<short>>, waveform_max array<short>, peak_sample array<int>, channel_flags array<long>"
EVENTS_V3 = "entry long, evt long, time double, det array<int>, plane array<int>, id0 array<int>, id1 array<int>, chip array<int>, channel array<int>, waveform array<array<short>>, adc array<int>, rawhitid array<long>, hit_time_ns array<double>"
CHANNELS = "board_id int, chip_id int, channel_id int, det int, plane int, id0 int, id1 int, pedestal double, noise_sigma double, gain double, polarity int, status long"
METADATA = "schema_version int, source_format string, converter_version string, geometry_source string"

#: Converter inputs.
APV_RAW = "apv_evt long, apv_id array<int>, apv_ch array<int>, apv_q array<array<short>>, time_s long, time_us long"
APV_PEDESTALS = "apv_id array<int>, apv_ch array<int>, apv_pedstd array<double>"
VMM_HITS = "id long, det int, plane int, fec int, vmm int, ch int, adc int, time double"


def schema(name: str) -> StructType:
    """The schema of a table by its constant's name, e.g. schema("TRACKS")."""
    return _schema(globals()[name.upper()])
