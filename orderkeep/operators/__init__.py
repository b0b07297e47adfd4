"""orderkeep.operators"""
