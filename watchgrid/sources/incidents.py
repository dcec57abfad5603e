"""Recorded incidents, by phases."""

# Duration in seconds; phases as name, start and end as shares of the duration, actions, and what is known of their kinds.
INCIDENTS = {
    "hf_2026_07": {
        "duration_s": 387960.0,
        "net_bytes_range": [1000.0, 100000.0],
        "phases": [
            {"name": "recon", "start": 0.0142, "end": 0.9997, "actions": 6191, "kinds": ["read", "bash", "net"]},
            {"name": "rce", "start": 0.0144, "end": 0.9958, "actions": 2911, "kinds": ["bash", "read"]},
            {"name": "dropper", "start": 0.032, "end": 1.0, "actions": 6972, "kinds": ["net", "bash", "write"]},
            {"name": "exfil", "start": 0.1087, "end": 0.9869, "actions": 56, "kinds": ["net", "bash", "read"]},
            {"name": "c2", "start": 0.1219, "end": 0.9731, "actions": 114, "kinds": ["bash", "net"]},
            {"name": "evasion", "start": 0.1584, "end": 0.8551, "actions": 6, "kinds": ["bash", "write"]},
            {"name": "kubernetes", "start": 0.5169, "end": 0.7708, "actions": 87, "kinds": ["net", "read", "bash"]},
            {"name": "supply_chain", "start": 0.5696, "end": 0.9935, "actions": 69, "kinds": ["net", "bash"]},
            {"name": "tailscale", "start": 0.6209, "end": 0.9943, "actions": 115, "kinds": ["bash", "net"]},
        ],
    },
    "miasma_2026_06": {
        "duration_s": 49.0,
        "phases": [
            {"name": "agent_control_files", "start": 0.0, "end": 1.0, "actions": 20, "mix": {"ctrl": 1.0}},
            {"name": "payload_dropper_writes", "start": 0.0, "end": 1.0, "actions": 5, "mix": {"write": 1.0}, "write_bytes_each": 4300000.0},
            {"name": "package_json_writes", "start": 0.0, "end": 1.0, "actions": 5, "mix": {"write": 1.0}, "write_bytes_each": 1000.0},
            {"name": "pushes", "start": 0.0, "end": 1.0, "actions": 5, "mix": {"net": 1.0}, "net_bytes_each": 4300000.0},
        ],
    },
}
