"""Table schemas of the ledger. Nothing is inferred; a store of another version is refused."""

from __future__ import annotations

VERSION = 1

MONEY = "struct<asset: string, amount: string>"
PROVENANCE = "struct<adapter_id: string, provider_id: string, surface: string, observed_at: string, received_at: string, effective_at: string, staleness: string, completeness: string>"
TABLES = {
    "observation": f"adapter_id string, resource_id string, local_id string, revision long, crawl_id long, arrival_index long, derivation string, fingerprint string, content_hash string, provider_id string, supersedes_provider_id string, state string, tombstone_reason string, surface string, posting string, amount {MONEY}, fees {MONEY}, raw_sign string, description string, provider_extra string, received_at string, provenance {PROVENANCE}",
    "seen": "adapter_id string, local_id string, revision long, crawl_id long, derivation string, fingerprint string",
    "balance": f"balance_id long, adapter_id string, read_id long, resource_id string, category string, canonical_hint string, amount {MONEY}, provenance {PROVENANCE}, outcome string",
    "adapter_read": "adapter_id string, read_id long",
    "retraction": "adapter_id string, local_id string, resource_id string, revision long, reason string, crawl_id long, retracted_at string",
    "discrepancy": "adapter_id string, resource_id string, kind string, crawl_id long, detail string, noted_at string",
    "crawl": "crawl_id long, adapter_id string, resource_id string, started_at string, start_page string, next_page string, derivation string, fingerprint string, drained boolean, complete boolean, disqualified_reason string",
    "adapter": "adapter_id string, argv array<string>, noted_at string",
    "resource": "adapter_id string, resource_id string, kind string, label string, fingerprint string, provider_id string, crawl_id long, noted_at string",
    "page_status": "crawl_id long, page_no long, adapter_id string, resource_id string, outcome string, as_of string, degraded array<struct<local_id: string, bytes: long>>, cursor_resumable string, next string",
}
# The closed vocabularies of the wire.
VOCABULARIES = {
    "staleness": ("live", "cached", "unavailable"),
    "completeness": ("complete", "partial", "unknown"),
    "canonical_hint": ("available", "total", "pending", "held", "confirmed", "unconfirmed"),
    "state": ("active", "tombstoned"),
    "posting": ("pending", "posted", "unknown"),
    "raw_sign": ("provider_positive", "provider_negative"),
    "cursor_resumable": ("exact", "batch_restart", "none"),
    "outcome": ("fetched", "not_fetched", "stale", "rate_limited", "unavailable", "reauth_required", "revoked", "gone", "sca_required"),
    "error_code": ("unsupported_protocol", "unsupported", "invalid_request", "not_ready", "internal"),
}
ESPLORA_TX = "array<struct<txid: string, fee: long, status: struct<confirmed: boolean, block_height: long, block_hash: string, block_time: long>, vin: array<struct<prevout: struct<scriptpubkey_address: string, value: long>>>, vout: array<struct<scriptpubkey_address: string, value: long>>>>"
ESPLORA_ADDRESS = "struct<chain_stats: struct<funded_txo_sum: long, spent_txo_sum: long>, mempool_stats: struct<funded_txo_sum: long, spent_txo_sum: long>>"
WALLETS = "struct<wallets: array<struct<resource_id: string, label: string, addresses: array<string>>>>"
