"""DataFrame-to-DataFrame operators; column names are parameters, results are lazy unless said otherwise."""
