"""Set-based operators over captions, jobs, versions, requests and scores."""
