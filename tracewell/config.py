"""Every threshold of the pipeline in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Severity bands of the 0-100 risk score
    risk_critical_min: float = 85.0
    risk_high_min: float = 65.0
    risk_medium_min: float = 40.0

    # Alert list
    alert_min_probability: float = 0.40
    max_alerts: int | None = None  # no limit; a number keeps the highest
    near_miss_min: float = 0.20

    # Network evidence
    impossible_travel_kmh: float = 900.0
    first_spy_tau_sec: float = 1.5
    first_spy_default_gap_sec: float = 0.3
    standard_port: int = 8333
    velocity_cap_kmh: float = 20000.0

    # Action rules
    freeze_window_min: float = 30.0
    freeze_min_risk: float = 65.0
    trace_max_hops: int = 4
    layering_min_btc: float = 1.0
    dormant_h: float = 6.0
    seed_link_hops: int = 4
    min_peel_chain: int = 3
    no_seed_path: int = 20
    min_balance_btc: float = 1e-4

    # Forward tracing
    trace_start_spends: int = 25
    trace_spends_per_output: int = 3
    trace_max_transactions: int = 600

    # Clustering
    sweep_min_inputs: int = 10
    split_min_parts: int = 7
    split_max_cv: float = 0.05
    split_max_sender_degree: int = 6

    # Flow graph
    hub_degree: int = 60
    pagerank_alpha: float = 0.85
    pagerank_tol: float = 1e-8
    pagerank_max_rounds: int = 200
    taint_decay: float = 0.9
    taint_rounds: int = 8
    max_hops: int = 8
    any_direction_max_hops: int = 4
    hops_missing: int = 99
    hops_cap: int = 20

    # Mixer traversal
    min_pool: int = 3
    satoshi: float = 1e-8
    min_slack_tol: float = 2e-6
    exposure_top: int = 4

    # Cash-out forecast
    min_typology_samples: int = 5
    min_samples: int = 3
    actor_weight: float = 3.0
    smoothing: float = 0.5

    # Same-operator leads
    operator_min_tx: int = 3
    operator_max_tx: int | None = None  # no limit; a number leaves busier clusters out
    operator_top: int = 5
    behaviour_cap: float = 0.6
    network_cap: float = 0.9
    fee_scale: float = 0.35

    # Feedback
    verdict_weight: float = 5.0


SETTINGS = Settings()

# Fixed values ---------------------------------------------------------------------------------
RISKY_ASN_TYPES = ("TOR_EXIT", "VPN", "BULLETPROOF")
ASN_TYPES = ("RESIDENTIAL", "DATACENTER", "VPN", "TOR_EXIT", "BULLETPROOF", "UNKNOWN")
SCRIPT_TYPES = ("P2PKH", "P2SH", "P2WPKH", "P2WSH", "P2TR")
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
CROSS_CHAIN_TYPES = ("SWAP", "BRIDGE")
EXIT_TYPES = ("VASP", "SWAP", "BRIDGE")
TX_CLASSES = ("normal", "peel", "coinjoin", "fan_out", "fan_in", "round_trip")
ACTION_PRIORITY = {
    "IMMEDIATE_FREEZE_DRAFT": 1,
    "DRAFT_SECTION_94_BNSS": 2,
    "CROSS_CHAIN_EXIT": 3,
    "FIU_REFERRAL_PACK": 4,
    "PASSIVE_TAINT_MONITOR": 5,
    "REVIEW_LIKELY_BENIGN": 6,
    "ANALYST_REVIEW": 7,
}
OPERATOR_WEIGHTS = {"software": 1.0, "script": 0.5, "diurnal": 1.0, "fee": 0.3}
HOUR_KERNEL = (0.25, 0.5, 0.25)
# ----------------------------------------------------------------------------------------------

# Title, rule and legal basis printed for every action -----------------------------
ACTION_TEXT = {
    "IMMEDIATE_FREEZE_DRAFT": (
        "Draft freeze / hold request to exchange",
        "Funds traced (≤ 4 hops) to a known exchange deposit made ≤ 30 min after receipt or ≤ 30 min before the latest data, and risk ≥ 65",
        "Section 106 BNSS 2023 (seizure of property), request to the exchange to hold the credited funds"),
    "DRAFT_SECTION_94_BNSS": (
        "Draft Section 94 BNSS requisition (KYC + records)",
        "Funds traced (≤ 4 hops) to an exchange that operates in India / is registered with FIU-IND",
        "Section 94 BNSS 2023 (summons to produce documents or other things)"),
    "CROSS_CHAIN_EXIT": (
        "Funds left Bitcoin: request swap records, trace the other chain",
        "Funds traced (≤ 4 hops) to a known swap service or bridge (e.g. BTC → XMR / ETH), or to a transaction whose OP_RETURN memo names a "
        "swap destination. A Bitcoin freeze no longer reaches them",
        "Section 94 BNSS 2023 to the swap service (Letter of Request, Section 112 BNSS, if offshore) for the order: payout chain, payout address, "
        "IP, account; then trace on the destination chain"),
    "FIU_REFERRAL_PACK": (
        "Prepare FIU-IND intelligence referral pack",
        "≥ 1 BTC moved, broadcast via Tor / VPN / bulletproof hosting, with a layering pattern (peel chain, CoinJoin or fan-out)",
        "PMLA 2002 intelligence sharing; the pack goes to the IO / FIU-IND liaison, not filed as an STR"),
    "PASSIVE_TAINT_MONITOR": (
        "Put on passive taint watch",
        "Unspent balance, dormant ≥ 6 h, linked to a seed wallet (taint > 0 or ≤ 4 hops)",
        "No legal step yet. Watch the funds and re-alert when they move"),
    "REVIEW_LIKELY_BENIGN": (
        "Review as a likely false positive",
        "The wallet is a known exchange / mining-pool address, or is funded by a mining pool with no seed link and no risky infrastructure",
        "None. Confirm or reject; the verdict feeds model retraining"),
    "ANALYST_REVIEW": ("Manual analyst review", "No directive rule matched. Read the reasons and evidence", "None"),
}
# ------------------------------------------------------------------------------------------------
