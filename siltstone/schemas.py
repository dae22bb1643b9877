"""Explicit schemas of the knowledge index; nothing is inferred on read."""

from __future__ import annotations

DOCUMENTS = "id string, nodeToken string, objToken string, title string, parentTitle string, url string, revisionId long, contentHash string, updatedAt string, syncedAt timestamp, chunkCount int, doc_pos long"
CHUNKS = "id string, documentId string, nodeToken string, title string, parentTitle string, heading string, url string, content string, contextualText string, tokens array<string>, embedding array<float>, chunk_pos long"
MENTION = "struct<documentId:string,documentTitle:string,documentUrl:string,context:string>"
RESOURCES = f"id string, url string, normalizedUrl string, title string, domain string, category string, mentions array<{MENTION}>"
SYNC_STATE = "status string, startedAt timestamp, completedAt timestamp, documentCount long, chunkCount long, embeddedChunkCount long, embeddingProvider string, warnings array<string>"
NODES = "spaceId string, nodeToken string, objToken string, objType string, nodeType string, parentNodeToken string, title string, hasChild boolean"
TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS, "resources": RESOURCES, "sync_state": SYNC_STATE}
