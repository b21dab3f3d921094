"""DataFrame to DataFrame operators; none of them runs a job on its own unless it says so."""
