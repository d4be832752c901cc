"""Declared shapes of the inputs."""

from __future__ import annotations

DEVICE = (
    "struct<callsign:string,frequency:string,eirp:string,transmitPower:string,antennaHeight:double,"
    "antenna:struct<gain:double>,location:struct<name:string,state:string,geom:struct<string:string,wkt:string>>>"
)
#: One licensed system with its devices, as GraphQL exports and the station scans give it. ``frequency``,
#: ``eirp`` and ``transmitPower`` are JSON text, since exports hold numbers, strings or objects there.
SYSTEM = f"id string, devices array<{DEVICE}>, licence struct<type:string,subtype:string>"

MEASUREMENT = "ordinal long, freq_mhz double, snr_db double, obw_fraction double, score double, power_db double, band string"

#: One sweep event; scores and frequencies may be numbers or numeric strings.
SWEEP_EVENT = (
    "type string, channels array<struct<band:string,fc_mhz:string,snr_db:double,obw_fraction:double,"
    "channel_power_db:double,score:string>>"
)
