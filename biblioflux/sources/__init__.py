"""biblioflux.sources"""
